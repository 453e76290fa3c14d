"""Operator 3: toxicity from a learnt lexicon, misspellings included, weighed by context.

The lexicon holds whole words and word stems that labelled toxic texts have and clean ones
lack. Its entries stand in a trie; the Levenshtein automaton of a word, run over the trie,
finds entries that the word misspells; forms that clean texts use are none. A window of words around each hit tells quotation from
abuse, and a logistic model over the hits of a text gives its score.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import over_arrow, released, small, small_batches, steps, stored
from waymark.llm.components import components
from waymark.llm.neardup import signatures
from waymark.llm.textkernel import Words, gather, mix, shingle_sets

#: A term needs this many labelled toxic texts that are no copies of each other. No bound grows with the corpus.
MIN_TEXTS = 3
#: It must be this many times likelier in toxic than in clean texts (half a text added to both).
MIN_ODDS = 25.0
#: Minima that texts must have in common to count as copies: at similarity 0.75 one of the
#: keys of this many agrees with a probability of 0.994, at 0.3 of 0.02.
COPY_WIDTH = 6
#: An entry is strong, one hit being evidence enough, if at least this share of its texts is expected to be toxic;
#: as many texts as PRIOR_TEXTS are counted in that are toxic as often as those of entries are in the half that didn't choose them.
STRONG, PRIOR_TEXTS = 0.97, 10
STEM_LENGTHS = range(4, 8)
#: Without known clean forms, only entries of at least this length match words one edit away.
FUZZY_LENGTH = 6
#: Forms whose kind a trie remembers.
REMEMBERED = 30_000
#: Written forms whose kind and marks are kept between steps: at some 100 bytes each.
FORMS_HELD = 100_000
#: Text bytes that are searched for hits at once.
SEARCHED_BYTES = 1 << 20
#: Counted terms that a task passes on at once.
HELD_TERMS = 100_000
#: Words of a block whose pairs of text and term are held at once (of one text at least).
HELD_WORDS = 100_000
#: Text bytes whose terms are counted together: the more, the fewer rows are passed on.
COUNTED_BYTES = 4 << 20
#: Characters that stand for letters they look like; 1, ! and | stand for two.
_LOOKS = [str.maketrans("0345678@$1!|оаесрхуі", "oeasgtbas" + bar + "oaecpxyi") for bar in ("iii", "lll")]
#: Words on either side that make a hit's context.
CONTEXT = 8
_EDGES = "\"'“”„«»‹›‘’()[]{}<>.,;:!?¡¿…*#$%&|-_/\\ \t\n\r\v\f"
_OPEN, _CLOSE = "\"“„«‹‘'(", "\"”“»›’')"
_SAID = frozenset("said says say wrote writes called quoted quote cites reported claimed dit disait écrit sagte schrieb zitiert dijo escribió citó".split())
_YOU = frozenset("you your you're u tu vous toi ton votre du dich dein sie ihr usted ustedes tú te".split())


_LOOKED = re.compile(f"[{re.escape(''.join(map(chr, _LOOKS[0])))}]")
#: Characters of the words that a filter step holds at once.
FILTERED = 1 << 19


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums over the characters of strings (rows), each in its place and each one place earlier."""
    powers = np.cumprod(np.full(codes.shape[1] + 1, 0x9E3779B97F4A7C15, np.uint64))
    return np.cumsum((codes + np.uint64(1)) * powers[1:], axis=1), np.cumsum((codes + np.uint64(1)) * powers[:-1], axis=1)


def _forms(here: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Keys of strings as they are and without each of their characters, from their sums; mix() makes hashes of them."""
    n = here.shape[1]
    out = np.empty((len(here), n + 1), np.uint64)
    out[:, 0] = here[:, -1] + np.uint64(n)
    np.subtract(moved[:, -1:] + np.uint64(n - 1), moved, out=out[:, 1:])
    out[:, 2:] += here[:, :-1]
    return out


class Known:
    """A set of hashes; a table of the keys' leading bits turns most others down."""

    def __init__(self, keys: np.ndarray) -> None:
        self.hashes = np.unique(mix(keys))
        bits = min(max(16, 5 + len(keys).bit_length()), 22)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[keys >> self.shift] = True

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The rows of which one key at least is in the set."""
        row, column = np.nonzero(self.table[keys >> self.shift])
        got = mix(keys[row, column])
        return row[self.hashes[np.minimum(np.searchsorted(self.hashes, got), len(self.hashes) - 1)] == got]


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)


class Filter:
    """Which words can lie one edit away from entries, for many words at once.

    Two strings one edit apart are equal, or one equals the other without a character, or both
    are equal without one character each; hashes of those forms are compared. The automaton
    decides on the few words that pass.
    """

    def __init__(self, words: Iterable[str], stems: Iterable[str]) -> None:
        sets = []
        for entries in (words, stems):
            by_length: dict[int, list[str]] = {}
            for e in entries:
                by_length.setdefault(len(e), []).append(e)
            forms = [_forms(*_sums(_codes(es, n))).ravel() for n, es in by_length.items()]
            lengths = sorted({n + d for n in by_length for d in (-1, 0, 1)} - {0})
            sets.append((lengths, Known(np.concatenate(forms)) if forms else None))
        (self.lengths, self.whole), (self.starts, self.stems) = sets
        self.width = max([1, *self.lengths, *self.starts])

    def passes(self, words: list[str]) -> np.ndarray:
        rows, owner = list(words), list(range(len(words)))
        for i, word in enumerate(words):
            if _LOOKED.search(word):
                for form in looks(word):
                    rows.append(form)
                    owner.append(i)
        good = np.zeros(len(words), bool)
        step = max(1, FILTERED // self.width)
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            size = np.fromiter(map(len, part), np.int64, len(part))
            here, moved = _sums(_codes([r[: self.width] for r in part], self.width))
            found = np.zeros(len(part), bool)
            for known, n, fits in [*((self.whole, n, size == n) for n in self.lengths), *((self.stems, n, size >= n) for n in self.starts)]:
                at = np.flatnonzero(fits & ~found)
                if len(at):
                    found[at[known.rows(_forms(here[at, :n], moved[at, :n]))]] = True
            good[np.array(owner[a : a + step], np.int64)[found]] = True
        return good


def looks(word: str) -> set[str]:
    """What a word with letters in it reads as when other characters stand for letters."""
    return {word.translate(t) for t in _LOOKS} - {word} if any(c.isalpha() for c in word) else set()


class Trie:
    """Lexicon entries: whole words and stems.

    ``clean``: the keys (see near()) of entries' misspellings that clean texts use. They are no
    hits; where they are known, entries of any length match words one edit away. An edit is a character changed,
    cut or added, or two neighbours swapped. ``strong``: the entries of which one hit, misspelt or not, is evidence enough.
    """

    def __init__(self, words: Iterable[str], stems: Iterable[str], clean: frozenset[tuple[str, bool]] | None = None, strong: frozenset[str] = frozenset()) -> None:
        self.words, self.stems, self.strong = frozenset(words), frozenset(stems), strong
        self.lengths = sorted({len(s) for s in self.stems})
        self.clean = clean or frozenset()
        self.root: dict = {}
        self.known: dict[str, int] = {}
        self.keys: dict[str, set[tuple[str, bool]]] = {}
        self.forms: dict[str, int] = {}
        shortest = FUZZY_LENGTH if clean is None else 1
        entries = [e for e in [*((w, False) for w in self.words), *((s, True) for s in self.stems)] if len(e[0]) >= shortest]
        for entry, stem in entries:
            node = self.root
            for c in entry:
                node = node.setdefault(c, {})
            node[""] = (entry, stem)
        self.shortest = min((len(e) for e, _ in entries), default=0)
        self.filter = Filter(self.words, self.stems)

    def exact(self, word: str) -> bool:
        return word in self.words or any(word[:n] in self.stems for n in self.lengths)

    def entries(self, word: str) -> set[str]:
        """The entries that the word is or begins with."""
        return ({word} & self.words) | {word[:n] for n in self.lengths if word[:n] in self.stems}

    def kind(self, word: str) -> int:
        """1 for an entry or a word that reads as one, 2 for a misspelt entry, 2 more for strong entries, else 0."""
        got = self.known.get(word)
        if got is None:
            met = self.entries(word)
            if not met and (word, False) not in self.clean:
                met = set().union(*map(self.entries, looks(word)))
            got = 1 if met else 0
            if not met:
                met = {entry for key, entry in self._near(word) if key not in self.clean}
                got = 2 if met else 0
            got += 2 * bool(met & self.strong)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = got
        return got

    def misspelt(self, word: str) -> bool:
        """Whether an entry lies one edit away, look-alike characters being none, and clean texts don't write so."""
        return any(key not in self.clean for key, _ in self._near(word))

    def near(self, word: str) -> set[tuple[str, bool]]:
        """Keys by which a word that is no entry misspells entries: (the word, False) for all of it, (its beginning, True) for stems."""
        got = self.keys.get(word)
        if got is None:
            got = set() if self.exact(word) else ({(word, False)} if self._reads(word) else set()) | {key for key, _ in self._near(word)}
            if len(self.keys) >= REMEMBERED:
                self.keys.clear()
            self.keys[word] = got
        return got

    def _reads(self, word: str) -> bool:
        return any(self.exact(x) for x in looks(word))

    def _near(self, word: str):
        if len(word) < self.shortest - 1 or not self.root:
            return
        for form in {word, *looks(word)}:
            yield from (((word[:n], stem), entry) for n, stem, entry in self._walk(form))

    def _walk(self, word: str):
        """(length, is stem, entry) of the word's beginnings at most one edit away from entries; of a stem, the beginning of its own length, else the longer, else the shorter one.

        A state of the automaton is a place in the word and whether the edit is spent. Before
        that one path of the trie agrees with the word, and each edit leaves it for another that must agree to its end.
        """
        size, ends = len(word), []

        def follow(node, i):
            while node is not None:
                if "" in node:
                    ends.append((*node[""], i))
                node = node.get(word[i]) if i < size else None
                i += 1

        node, i = self.root, 0
        while node is not None:
            if "" in node:
                ends.append((*node[""], i))
            if i < size:
                follow(node, i + 1)  # a character of the word is one too many
            for c, child in node.items():
                if c:
                    follow(child, i)  # the word lacks c
                    if i < size:
                        follow(child, i + 1)  # it has another one
                    if i + 1 < size and word[i + 1] == c:
                        follow(child.get(word[i]), i + 2)  # c and its neighbour are swapped
            node = node.get(word[i]) if i < size else None
            i += 1
        starts: dict[str, int] = {}
        for entry, stem, n in ends:
            if stem:
                starts[entry] = min(starts.get(entry, n), n, key=lambda n: (n - len(entry)) % 3)
            elif n == size:
                yield n, False, entry
        yield from ((n, True, entry) for entry, n in starts.items())


#: Terms of words: their names, whether each is a stem, and (number of a word, number of a term of it) pairs in the order of the words.
Terms = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]


def terms_of(words: list[str]) -> Terms:
    """Each word itself and its beginnings."""
    column = pa.array(words, pa.large_string())
    size = pc.utf8_length(column).to_numpy()
    own = np.flatnonzero(size > 2)
    names, stems, owner, term, known = [column.take(pa.array(own))], [np.zeros(len(own), bool)], [own], [np.arange(len(own))], len(own)
    for n in STEM_LENGTHS:
        at = np.flatnonzero(size >= n)
        coded = pc.utf8_slice_codeunits(column.take(pa.array(at)), 0, n).dictionary_encode()
        names.append(coded.dictionary)
        stems.append(np.ones(len(coded.dictionary), bool))
        owner.append(at)
        term.append(coded.indices.to_numpy().astype(np.int64) + known)
        known += len(coded.dictionary)
    owner, term = np.concatenate(owner), np.concatenate(term)
    order = np.argsort(owner, kind="stable")
    return pa.concat_arrays(names), np.concatenate(stems), owner[order], term[order]


def listed(each: Iterable[Iterable[tuple[str, bool]]]) -> Terms:
    """The (term, is stem) of each word as Terms."""
    known: dict[tuple[str, bool], int] = {}
    pairs = np.array([(i, known.setdefault(t, len(known))) for i, mine in enumerate(each) for t in mine], np.int64).reshape(-1, 2)
    return pa.array([t for t, _ in known], pa.large_string()), np.array([s for _, s in known], bool), pairs[:, 0], pairs[:, 1]


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorts in place."""
    values.sort()
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def _counted(batch: pa.RecordBatch, terms: Callable[[list[str]], Terms]) -> Iterable[pa.RecordBatch]:
    """term, stem, toxic, copy_of, n of a block of texts: how many have each term."""
    found = Words(batch.column("text"), lower=False)
    if not len(found.begin):
        return
    first = found.first
    code, forms = word_forms(found)
    del found
    number: dict[str, int] = {}
    word_of = np.array([number.setdefault(f.strip(_EDGES).lower(), len(number)) for f in forms], np.int64)
    words = list(number)
    del forms, number
    names, stems, owner, term_of = terms(words)
    if not len(names):
        return
    begin = np.searchsorted(owner, np.arange(len(words) + 1))
    size = np.diff(begin)
    groups = batch.column("copy_of").dictionary_encode()
    group = groups.indices.fill_null(-1).to_numpy().astype(np.int64) + 1
    many = 4 * (len(groups.dictionary) + 1)
    kind = 4 * group + batch.column("toxic").to_numpy().astype(np.int64)
    # few texts at a time: their pairs of text and term are many
    keys, counts, a = [], [], 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(first, first[a] + HELD_WORDS, "right")) - 1)
        text = np.repeat(np.arange(b - a), np.diff(first[a : b + 1]))
        text, word = np.divmod(_distinct(text * len(words) + word_of[code[first[a] : first[b]]]), len(words))
        term = gather(term_of, begin[word], size[word])
        text, term = np.divmod(_distinct(np.repeat(text, size[word]) * len(names) + term), len(names))
        key, n = np.unique(term * many + kind[a:b][text], return_counts=True)
        keys.append(key)
        counts.append(n)
        a = b
    key, n = np.concatenate(keys), np.concatenate(counts)
    del code, word_of, owner, term_of, begin, size, text, word, term, keys, counts
    order = np.argsort(key)
    key, n = key[order], n[order]
    del order
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, n = key[cut], np.add.reduceat(n, cut)
    for a in range(0, len(key), HELD_TERMS):
        term, rest = np.divmod(key[a : a + HELD_TERMS], many)
        own = rest < 4  # copies count as one text
        copies = groups.dictionary.take(pa.array(rest // 4 - 1, mask=own)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([names.take(pa.array(term)).cast(pa.string()), pa.array(stems[term]), pa.array(rest % 4), copies, pa.array(np.where(own, n[a : a + HELD_TERMS], 1))], ["term", "stem", "toxic", "copy_of", "n"])


def word_forms(found: Words) -> tuple[np.ndarray, list[str]]:
    """The number of each word's form, and the distinct forms of a block."""
    spans = np.r_[found.begin, len(found.raw)]
    raw = np.ascontiguousarray(found.raw)
    coded = pa.LargeStringArray.from_buffers(len(found.begin), pa.py_buffer(spans.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
    return coded.indices.to_numpy(), [f.strip(" \t\n\r\v\f") for f in coded.dictionary.to_pylist()]


def _term_counts(texts: DataFrame, terms: Callable[[list[str]], Terms] = terms_of) -> DataFrame:
    """term, stem, found, against and the same of each half (found0, ...): how many toxic and clean texts have each term, copies (``copy_of``) as one.

    ``terms`` names the terms of each of a list of words.
    """

    def count(batches):
        if terms is terms_of:
            _trie.cache_clear()  # a worker lives on, and no lexicon is known yet
        for batch in steps(batches, size=COUNTED_BYTES):
            yield from _counted(batch, terms)

    each = texts.select("text", (F.col("toxic") + 2 * F.col("half")).cast("long").alias("toxic"), "copy_of").mapInArrow(count, "term string, stem boolean, toxic long, copy_of long, n long")
    each = each.groupBy("term", "stem", "toxic", "copy_of").agg(F.sum("n").alias("n"))
    one = F.when(F.col("copy_of").isNull(), F.col("n")).otherwise(1)
    halves = each.groupBy("term", "stem").agg(*[F.sum(F.when(F.col("toxic") == t, one).otherwise(0)).alias(c) for t, c in enumerate(("against0", "found0", "against1", "found1"))])
    return halves.withColumns({c: F.col(f"{c}0") + F.col(f"{c}1") for c in ("found", "against")})


def with_copies(rows: DataFrame) -> DataFrame:
    """Distinct text, toxic, times (rows), copy_of (a number that near-equal texts have in common, null for a text without copies) and half (0 or 1, alike for copies)."""

    def keys(batches):
        for batch in steps(batches):
            marks = signatures(*shingle_sets(batch.column("text"), 5))
            marks = marks[:, : marks.shape[1] // COPY_WIDTH * COPY_WIDTH].reshape(len(marks), -1, COPY_WIDTH).astype(np.uint64)
            out = np.broadcast_to(np.arange(1, marks.shape[1] + 1, dtype=np.uint64), marks.shape[:2]).copy()
            for i in range(COPY_WIDTH):
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + marks[:, :, i])
            owner = np.repeat(batch.column("id").to_numpy(), marks.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(out.ravel().view(np.int64))], ["id", "key"])

    texts = rows.groupBy("text", "toxic").agg(F.count("*").alias("times")).withColumn("id", F.xxhash64("text"))
    held = stored(texts.select("text", "id").dropDuplicates(["id"]).mapInArrow(keys, "id long, key long"), "copies")
    first = held.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = components(held.join(first, "key").select(F.col("id").alias("src"), F.col("first").alias("dst")), native=False)
    return texts.join(groups.select(F.col("node").alias("id"), F.col("component").alias("copy_of")), "id", "left").select("text", "toxic", "times", "copy_of", F.pmod(F.coalesce("copy_of", "id"), F.lit(2)).alias("half"))


def labelled(docs: DataFrame, labels: DataFrame, held_out: bool | None = False) -> DataFrame:
    """doc_id, text, toxic of labelled documents outside (or inside) the held-out fold."""
    mine = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out is not None:
        mine = mine.where(in_fold("doc_id") == F.lit(held_out))
    return docs.select("doc_id", "text").join(small(mine), "doc_id")


def in_fold(column: str):
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def _sizes(texts: DataFrame) -> dict[str, tuple[int, int]]:
    """How many toxic and clean texts there are in both halves and in each, copies as one."""
    sizes = texts.groupBy("half", "toxic").agg(F.sum(F.col("copy_of").isNull().cast("long")).alias("alone"), F.countDistinct("copy_of").alias("groups")).collect()
    n = {(r.half, int(r.toxic)): r.alone + r.groups for r in sizes}
    each = {str(h): (n.get((h, 1), 0), n.get((h, 0), 0)) for h in (0, 1)}
    return each | {"": tuple(map(sum, zip(*each.values())))}


def _odds(found, against, n_toxic: int, n_clean: int):
    return (found + 0.5) / (against + 0.5) * (n_clean / n_toxic)


class Lexicon:
    """Entries, the strong ones among them, and the misspellings that clean texts use; an entry that has any isn't strong."""

    def __init__(self, words: frozenset[str] = frozenset(), stems: frozenset[str] = frozenset(), strong: frozenset[str] = frozenset(), clean: frozenset[tuple[str, bool]] = frozenset()) -> None:
        self.words, self.stems, self.strong = words, stems, strong
        self.used(clean)

    def used(self, clean: frozenset[tuple[str, bool]]) -> None:
        """Take over the misspellings that clean texts use."""
        trie = _trie(self.words, self.stems, frozenset())
        self.clean, self.strong = clean, self.strong - {entry for form, _ in clean for _, entry in trie._near(form)}

    def features(self, column: pa.Array) -> np.ndarray:
        return features(column, self.words, self.stems, self.clean, self.strong)


def learn_lexicon(train: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """(words, stems) from labelled texts; copies count once."""
    texts = stored(with_copies(train), "texts")
    found = _lexicons(texts, _sizes(texts), ("",))[""]
    return found.words, found.stems


def _lexicons(texts: DataFrame, sizes: dict[str, tuple[int, int]], parts: tuple[str, ...]) -> dict[str, Lexicon]:
    """The lexicon of all texts ("") and of the halves asked for, from one count.

    A term is an entry by its own evidence: MIN_TEXTS toxic texts, MIN_ODDS, and a large-deviation
    bound by which all terms that chance alone would accept are one in number. It is strong if its expected share of
    toxic texts is STRONG. Only accepted terms reach the driver.
    """
    if not all(min(sizes[p]) for p in parts):
        return {p: Lexicon() for p in parts}
    tried = stored(_term_counts(texts).where(F.col("found") >= MIN_TEXTS), "terms")
    many, rows = float(np.log(max(tried.count(), 1))), {}
    for p in parts:
        base = sizes[p][0] / sum(sizes[p])
        found, against = F.col(f"found{p}"), F.col(f"against{p}")
        share = found / (found + against)
        clean = F.when(against > 0, against * F.log((1 - share) / (1 - base))).otherwise(0.0)
        good = tried.where((found >= MIN_TEXTS) & (_odds(found, against, *sizes[p]) >= MIN_ODDS) & (found * F.log(share / base) + clean >= many))
        rows[p] = good.select("term", "stem", found.alias("mine"), against.alias("clean"), "found0", "against0", "found1", "against1").collect()
    other = [(getattr(r, f"found{q}"), getattr(r, f"against{q}")) for p, q in (("0", "1"), ("1", "0")) for r in rows.get(p, ())]
    usual = (sum(f for f, _ in other) + 1) / (sum(f + g for f, g in other) + 1)
    out = {}
    for p in parts:
        words, stems = reduced({(r.term, r.stem): r.mine for r in rows[p]})
        sure = frozenset(r.term for r in rows[p] if (r.mine + usual * PRIOR_TEXTS) / (r.mine + r.clean + PRIOR_TEXTS) >= STRONG)
        out[p] = Lexicon(words, stems, sure & (words | stems))
    released(tried)
    return out


def _clean_forms(texts: DataFrame, lexicons: dict[str, Lexicon], sizes: dict[str, tuple[int, int]]) -> dict[str, dict[tuple[str, bool], int]]:
    """Of each lexicon, the keys of misspellings that its clean texts use, and how many do. An entry has few keys: its own length in characters, one changed."""
    words, stems = (frozenset().union(*(getattr(x, part) for x in lexicons.values())) for part in ("words", "stems"))
    if not (words or stems):
        return {p: {} for p in lexicons}

    def near(known: list[str]) -> Terms:
        trie = _trie(words, stems, frozenset())
        return listed(trie.near(w) if close else () for w, close in zip(known, trie.filter.passes(known)))

    counts = stored(_term_counts(texts, near), "forms")
    out = {}
    for p in lexicons:
        found, against = F.col(f"found{p}"), F.col(f"against{p}")
        rows = counts.where((against > 0) & (_odds(found, against, *sizes[p]) < MIN_ODDS)).select("term", "stem", against.alias("n")).collect()
        out[p] = {(r.term, r.stem): r.n for r in rows}
    released(counts)
    return out


def reduced(good: dict[tuple[str, bool], int]) -> tuple[frozenset[str], frozenset[str]]:
    """Entries without those that others make needless.

    A stem gives way to a longer entry that covers nearly all of its texts; else the entries
    that begin with it go.
    """
    cover: dict[str, int] = {}
    for (term, stem), n in good.items():
        for k in range(STEM_LENGTHS.start, len(term) + (not stem)):
            cover[term[:k]] = max(cover.get(term[:k], 0), n)
    stems: set[str] = set()
    words: set[str] = set()
    for (term, stem), n in sorted(good.items(), key=lambda x: (len(x[0][0]), not x[0][1])):
        if any(term[:k] in stems for k in range(STEM_LENGTHS.start, len(term) + (not stem))):
            continue
        if not stem:
            words.add(term)
        elif cover.get(term, 0) < 0.95 * n:
            stems.add(term)
    return frozenset(words), frozenset(stems)


@lru_cache(maxsize=2)
def _trie(words: frozenset[str], stems: frozenset[str], clean: frozenset[tuple[str, bool]] | None = None, strong: frozenset[str] = frozenset()) -> Trie:
    return Trie(words, stems, clean, strong)


FEATURES = ["plain", "fuzzy", "quoted", "you", "sure", "sure_fuzzy", "sure_quoted"]


def features(column: pa.Array, words: frozenset[str], stems: frozenset[str], clean: frozenset[tuple[str, bool]] | None = None, strong: frozenset[str] = frozenset()) -> np.ndarray:
    """Per text: plain hits (3 or more are 3), misspelt hits (2), quoted hits (2), whether a hit addresses someone, and whether a strong entry is hit plainly, misspelt or quoted."""
    trie = _trie(words, stems, clean, strong)
    n = len(column)
    out = np.zeros((n, len(FEATURES)), np.int64)
    found = Words(column, lower=False)
    if not len(found.begin):
        return out
    code, forms = word_forms(found)
    seen = trie.forms
    fresh = [f for f in forms if f not in seen]
    if len(seen) + len(fresh) > FORMS_HELD:
        seen.clear()
        fresh = forms
    plain = [f.strip(_EDGES).lower() for f in fresh]
    for form, word, close in zip(fresh, plain, trie.filter.passes(plain).tolist()):
        mark = (form[:1] in _OPEN) + 2 * (form.rstrip(".,;:!?")[-1:] in _CLOSE) + 4 * (word in _SAID) + 8 * (word in _YOU)
        seen[form] = 16 * (trie.kind(word) if close else 0) + mark
    kind, mark = np.divmod(np.fromiter(map(seen.__getitem__, forms), np.int64, len(forms)), 16)
    hits = np.flatnonzero(kind[code])
    text = np.searchsorted(found.first, hits, "right") - 1
    for at, t in zip(hits.tolist(), text.tolist()):
        low, high = max(at - CONTEXT, found.first[t]), min(at + CONTEXT + 1, found.first[t + 1])
        near = mark[code[low:high]]
        here = at - low
        quoted = bool((near[: here + 1] & 1).any() and (near[here:] & 2).any()) or bool((near[max(0, here - 3) : here] & 4).any())
        misspelt, sure = kind[code[at]] % 2 == 0, kind[code[at]] > 2
        part, most = (2, 2) if quoted else (1, 2) if misspelt else (0, 3)
        out[t, part] = min(out[t, part] + 1, most)
        if sure:
            out[t, 6 if quoted else 5 if misspelt else 4] = 1
        out[t, 3] |= int(not quoted and (near & 8).any())
    return out


def _design(cells: np.ndarray) -> np.ndarray:
    """A strong hit decides by itself; the others count. A weaker kind of a strong hit says nothing beside a plain one."""
    plain, fuzzy, quoted, you, sure, sure_fuzzy, sure_quoted = cells.T
    sure_fuzzy, sure_quoted = sure_fuzzy * (1 - sure), sure_quoted * (1 - sure) * (1 - sure_fuzzy)
    columns = [np.ones(len(cells)), plain >= 1, plain >= 2, plain >= 3, fuzzy >= 1, fuzzy >= 2, quoted >= 1, quoted >= 2, you, sure, sure_fuzzy, sure_quoted]
    return np.stack([np.asarray(c, float) for c in columns], 1)


#: Where strong hits are pulled to: the share STRONG of toxic texts for plain ones; of the way there for misspelt and quoted ones.
MISSPELT_SHARE, QUOTED_SHARE = 0.85, 0.35


def fit(cells: np.ndarray, positive: np.ndarray, total: np.ndarray, ridge: float = 0.05, pull: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression over counted cells (Newton steps), each pulled to a value that holds where no text shows it.

    That value is 0, and for hits of strong entries what lifts a text without hits to STRONG, or part of the way.
    """
    x = _design(cells)
    bare = ~x[:, 1:].any(1)
    lift = np.log(STRONG / (1 - STRONG)) - np.log((positive[bare].sum() + 0.5) / ((total - positive)[bare].sum() + 0.5))
    means, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    means[-3:] = lift * np.array([1, MISSPELT_SHARE, QUOTED_SHARE])
    penalty[0], penalty[8:] = 1e-6, pull
    loss = lambda w: float(total @ np.logaddexp(0, x @ w) - positive @ (x @ w) + penalty @ (w - means) ** 2 / 2)
    w = means.copy()
    w[0] = np.log(STRONG / (1 - STRONG)) - lift
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (total * p * (1 - p))) @ x + np.diag(penalty), x.T @ (positive - total * p) - penalty * (w - means))
        while np.abs(step).max() >= 1e-9 and loss(w + step) > loss(w):
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    # no kind of hit makes a text milder, and a quoted hit isn't worth more than a plain one
    w[1:] = np.maximum(w[1:], 0)
    w[11] = min(w[11], w[9])
    return w


class Model:
    """A learnt lexicon and the weights of its hits."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None) -> None:
        self.lexicon, self.weights = lexicon, weights
        self.words, self.stems, self.clean, self.strong = lexicon.words, lexicon.stems, lexicon.clean, lexicon.strong

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:  # nothing was labelled
            return np.zeros(len(column))
        return 1 / (1 + np.exp(-_design(self.lexicon.features(column)) @ self.weights))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled rows outside the held-out fold; a bounded number of counted cells reaches the driver.

    The weights see each half of the texts through the lexicon of the other half, so they know what
    hits are worth on texts that chose no entry. Where a half lacks toxic or clean texts, all texts serve for both.
    """
    small_batches(docs.sparkSession)
    texts = stored(with_copies(labelled(docs, labels)), "texts")
    sizes = _sizes(texts)
    parts = ("", "0", "1") if min(sizes["0"] + sizes["1"]) else ("",)
    lexicons = _lexicons(texts, sizes, parts)
    used = _clean_forms(texts, lexicons, sizes)
    for p, x in lexicons.items():
        x.used(frozenset(used[p]))
    if parts == ("",):
        # a form of one clean text stands for forms that no labelled text shows: the weights must see what those are worth
        seen_by = [(None, Lexicon(lexicons[""].words, lexicons[""].stems, lexicons[""].strong, frozenset(k for k, n in used[""].items() if n > 1)))]
    else:
        seen_by = [(0, lexicons["1"]), (1, lexicons["0"])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        half, got = batch.column("half").to_numpy(), np.zeros((batch.num_rows, len(FEATURES)), np.int64)
        for mine, x in seen_by:
            at = np.flatnonzero((half == mine) | (mine is None))
            got[at] = x.features(batch.column("text").take(pa.array(at)))
        return pa.RecordBatch.from_arrays([*map(pa.array, got.T), batch.column("toxic").cast(pa.int64()), batch.column("times")], [*FEATURES, "toxic", "times"])

    seen = over_arrow(texts, run, ", ".join(f"{c} long" for c in [*FEATURES, "toxic", "times"]), size=SEARCHED_BYTES)
    cells = seen.groupBy(*FEATURES).agg(F.sum(F.col("toxic") * F.col("times")).alias("positive"), F.sum("times").alias("total")).collect()
    released(texts)
    if not cells:
        return Model(lexicons[""], None)
    table = np.array([[*r] for r in cells], float)
    return Model(lexicons[""], fit(table[:, :-2], table[:, -2], table[:, -1]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is scored; null and empty texts score as texts without hits. Without labelled
    rows every score is 0. A null doc_id has a null fold. Repeated rows give repeated rows, labels
    that repeat a doc_id count as toxic if one says so; other columns are not read.
    """
    model = train(docs, labels)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text")))], ["doc_id", "score"])

    got = over_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double", size=SEARCHED_BYTES)
    return got.select("doc_id", in_fold("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, whatever their names; null and empty texts have no hit and stay. Texts of any length are read whole."""
    model = train(docs, labels)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.scores(batch.column("text")) < 0.5))

    return over_arrow(docs, run, docs.schema, size=SEARCHED_BYTES)
