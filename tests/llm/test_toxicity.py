import random
import tracemalloc

import pyarrow as pa
import pytest

from tests.llm.common import odd_documents
from waymark.llm import toxicity


def distance(a, b):
    """Edits, two swapped neighbours being one."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                new[-1] = min(new[-1], before[j - 2] + 1)
        before, row = row, new
    return row[-1]


def slip(rng, word):
    """Sometimes two neighbours swapped."""
    i = rng.randrange(max(1, len(word) - 1))
    return word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :] if rng.random() < 0.3 else word


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    entries = ["grublex", "snarfel", "zortplin"]
    trie = toxicity.Trie(entries, [])
    for _ in range(3000):
        word = list(rng.choice(entries))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice("abgrslx")])
        word = slip(rng, "".join(word))
        assert trie.misspelt(word) == any(distance(word, e) <= 1 for e in entries), word


def test_stems_match_beginnings():
    trie = toxicity.Trie(["abc"], ["grubl", "snarfe"])
    assert trie.exact("grublets") and trie.exact("abc") and not trie.exact("abcd")
    assert trie.misspelt("snarxels") and not trie.misspelt("gruxlets")  # short stems match exactly only


def test_context_tells_quotation():
    got = toxicity.features(pa.array(['He said "you grublex" to me', "you grublex fool", "a grublx here", "fine", None]), frozenset(["grublex"]), frozenset())
    assert got[:, :4].tolist() == [[0, 0, 1, 0], [1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored(docs, labels).where("held_out").join(labels, "doc_id").where("toxic is not null").collect()
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    caught = sum(r.predicted for r in toxic) / len(toxic)
    false = sum(r.predicted for r in clean) / len(clean)
    print("held out:", len(rows), "caught", caught, "false", false)
    assert caught >= 0.85 and false <= 0.03


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (3, 0), (3, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out is None for r in got if r.doc_id is None)
    assert toxicity.scored(docs, labels.limit(0)).where("score > 0").count() == 0
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == docs.count()


def test_rare_entries_are_learnt_and_copies_are_not(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    plain, insults = [word(6) for _ in range(400)], [word(9) for _ in range(125)]
    text = lambda *more: " ".join(rng.sample([*rng.choices(plain, k=40), *more], 40 + len(more)))
    rows = [(text(insults[i % 125]), 1) for i in range(1500)] + [(text(), 0) for _ in range(4500)]
    one = f"{text()} {text()} {text()} bystander {insults[0]}"
    rows += [(f"{one} {word(8)} {one[i:]}", 1) for i in range(40)]  # near copies of one toxic text
    words, stems = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    known = toxicity.Trie(words, stems)
    assert [w for w in insults if not known.exact(w)] == []  # each stands in 0.8 % of the toxic texts
    assert not known.exact("bystander") and not any(known.exact(w) for w in plain)


def test_short_entries_are_found_misspelt_unless_clean_texts_write_so(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(300)]
    text = lambda *more: " ".join(rng.sample([*rng.choices(plain, k=30), *more], 30 + len(more)))
    toxic, clean = ["moron", "idiot", "scum"], ["oron", "scam"]
    rows = [(text(toxic[i % 3]), 1) for i in range(90)] + [(text(rng.choice(clean)), 0) for _ in range(400)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(both.select("doc_id", "text"), both.select("doc_id", "toxic"))
    forms = ["m0ron", "1diot", "idi0t", "5cum", "morron", "oron", "scam", *plain[:5]]
    got = toxicity.features(pa.array(forms), model.words, model.stems, model.clean)[:, :2].sum(1).tolist()
    assert got == [1, 1, 1, 1, 1, 0, 0] + [0] * 5
    assert (model.scores(pa.array(["fine m0ron here", "the idi0t", "fine oron here", "a scam"])) >= 0.5).tolist() == [True, True, False, False]


def test_automaton_equals_edit_distance_on_short_entries():
    rng = random.Random(2)
    entries = ["scum", "moron", "ass"]
    trie = toxicity.Trie(entries, [], frozenset())
    for _ in range(3000):
        word = list(rng.choice(entries))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice("acmnorsu")])
        word = slip(rng, "".join(word))
        assert trie.misspelt(word) == any(distance(word, e) <= 1 for e in entries), word


def test_filter_passes_all_that_the_automaton_finds():
    rng = random.Random(6)
    trie = toxicity.Trie(["scum", "moron", "grublexian"], ["snarf", "blorbo"], frozenset())
    words = []
    for _ in range(6000):
        word = list(rng.choice(["scum", "moron", "grublexian", "snarfels", "blorbos", "plain", "blorb"]))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice("acmnorsu0@1é")])
        words.append("".join(word))
    words += ["", "x" * 5000, "😀moron"]
    passed = trie.filter.passes(words)
    assert all(p for w, p in zip(words, passed) if trie.kind(w) or trie.near(w))
    assert 100 < passed.sum() < len(words) - 100


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_learnt_model_weighs_misspelling_and_quotation(spark, sf):
    """With the model learnt from a whole table: one insult is enough, misspelt too, and quoted it scores lower."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    score = lambda *texts: model.scores(pa.array(texts)).tolist()
    for word, wrong in (("disgusting", ("disgustng", "digsusting", "disgust1ng")), ("idiot", ("idoit", "idiiot")), ("stupid", ("stuipd", "stupld"))):
        plain, quoted, fine = score(f"you are {word} they know", f'she said "{word}" to them', "they know of it")
        assert plain >= 0.5 > quoted > fine, (word, plain, quoted, fine)
        assert all(quoted < x <= plain + 1e-9 and x >= 0.5 for x in score(*(f"you are {w} they know" for w in wrong))), word


def block(rng, texts, words):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12)))
    rows = [" ".join(word() for _ in range(words)) for _ in range(texts)]
    kinds = [rng.randrange(4) for _ in rows]
    copies = [rng.choice([None, None, 5, -7]) for _ in rows]
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(kinds, pa.int64()), pa.array(copies, pa.int64())], ["text", "toxic", "copy_of"])


def test_counting_a_block_takes_little_memory():
    """Two workers count beside a full heap of an executor. pyarrow's pool stands beside this figure."""
    batch = block(random.Random(7), 600, 1000)
    assert 3.5e6 < batch.nbytes < toxicity.COUNTED_BYTES * 1.1
    tracemalloc.start()
    rows = sum(part.num_rows for part in toxicity._counted(batch, toxicity.terms_of))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB:", peak / 1e6, "rows:", rows)
    assert peak < 150e6


def test_counts_of_blocks_equal_plain_counts(monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_WORDS", 50)
    batch = block(random.Random(8), 60, 30)
    got, want = {}, {}
    for part in toxicity._counted(batch, toxicity.terms_of):
        for r in part.to_pylist():
            key = r["term"], r["stem"], r["toxic"], r["copy_of"]
            assert key not in got
            got[key] = r["n"]
    for r in batch.to_pylist():
        words = set(r["text"].split())
        for term, stem in {(w, False) for w in words if len(w) > 2} | {(w[:n], True) for w in words for n in toxicity.STEM_LENGTHS if len(w) >= n}:
            key = term, stem, r["toxic"], r["copy_of"]
            want[key] = want.get(key, 0) + 1 if r["copy_of"] is None else 1
    assert got == want


def test_workers_forget_the_tries_of_an_earlier_model(spark):
    """A Python worker outlives its tasks; while it counts for a new model, nothing of the last one takes its memory."""

    class Taken:  # stands for a frame; its function runs here
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            list(run(iter([block(random.Random(9), 2, 5)])))
            raise StopIteration

    toxicity._trie(frozenset(["grublex"]), frozenset())
    with pytest.raises(StopIteration):
        toxicity._term_counts(Taken())
    assert toxicity._trie.cache_info().currsize == 0


def test_edits_of_stems_name_the_beginning_they_take():
    trie = toxicity.Trie(["scum"], ["snarf"], frozenset())
    near = lambda word: {key for key, _ in trie._near(word)}
    assert near("snarxels") == {("snarx", True)} and near("snxarfels") == {("snxarf", True)} and near("snafels") == {("snaf", True)} and near("sanrfels") == {("sanrf", True)}
    assert near("scm") == near("scumm") - {("scumm", False)} | {("scm", False)} and near("xscumx") == set() == near("snels")


def test_batches_are_cut_by_bytes(spark):
    """Long rows would else make a batch of tens of MB, which the JVM and the Python worker hold at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    fresh = spark.newSession()
    docs = fresh.range(6000, numPartitions=1).selectExpr("id AS doc_id", "repeat('some words ', 200) AS text")
    labels = fresh.createDataFrame([(1, 0)], "doc_id long, toxic int")
    size = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"]) for b in batches), "size long")
    assert size.agg({"size": "max"}).first()[0] > 12e6
    assert toxicity.without_toxic(docs, labels).count() == 6000
    assert size.agg({"size": "max"}).first()[0] < 4.3e6 and size.count() >= 3
    own = spark.newSession()
    own.conf.set(key, "1m")
    toxicity.without_toxic(own.createDataFrame(docs.limit(3).collect()), own.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert own.conf.get(key) == "1m"
