"""Phrase collocation mining by pattern growth over projected occurrences.

The words are counted first; a phrase can only be frequent if all its words are. Every occurrence
of a frequent word (the prefix) is projected to the words that may follow it within its piece, and
a prefix's projected occurrences meet in one task, which extends it to the right depth-first as
long as the extension is frequent. A prefix with too many occurrences for one task is extended by
one word in Spark instead, and its extensions become prefixes of their own, so no task ever holds
more than ``PREFIX_ROWS`` occurrences of a prefix, whatever share of the corpus it has.

Defined cases: a null text is empty, a null lang is ``und``; repeated rows count as often as they
stand there; texts of any length are read whole; an empty table gives no rows; no other column is
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import BROADCAST_ROWS, released, small, steps, stored, text_buffer

#: Words of the longest candidate.
LONGEST = 4
#: Occurrences of a prefix that one task extends; at 12 or 24 bytes each.
PREFIX_ROWS = 8_000_000
#: Occurrences that a shuffle partition is planned for.
PARTITION_ROWS = 2_000_000
#: Bytes of frequent words that may be broadcast.
BROADCAST_BYTES = 32 << 20
_STEP = 4 << 20
_INSIDE, _SPACE, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = _SPACE
_CLASS[[*b".,;:!?", 10, 11, 12, 13]] = _BREAK


class Pieces:
    """The words of a block of texts: their bytes, the row of each, and whether the next one is in its piece."""

    def __init__(self, column: pa.Array) -> None:
        raw, texts = text_buffer(column)
        raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
        kind = _CLASS[raw]
        n = len(raw)
        inside = kind == _INSIDE
        edge = np.zeros(n + 1, bool)
        edge[texts] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        begin = np.flatnonzero(inside & (~before | edge[:n]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        offsets = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(end - begin, out=offsets[1:])
        data = np.ascontiguousarray(raw[inside])
        self.words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data))
        first = np.searchsorted(begin, texts)
        self.row = np.repeat(np.arange(len(texts) - 1), np.diff(first))
        breaks = np.cumsum(kind == _BREAK, dtype=np.int32)
        self.goes_on = np.zeros(len(begin), bool)
        if len(begin) > 1:
            self.goes_on[:-1] = (breaks[begin[1:]] == breaks[end[:-1] - 1]) & (self.row[1:] == self.row[:-1])


def _langs(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each row's lang, and the langs."""
    coded = column.cast(pa.string()).fill_null("und").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step in steps(batches, "text", _STEP):
        pieces, (lang, langs) = Pieces(step.column("text")), _langs(step.column("lang"))
        coded = pieces.words.dictionary_encode()
        size = max(1, len(coded.dictionary))
        key, n = np.unique(lang[pieces.row] * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.record_batch([langs.take(pa.array(key // size)), coded.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word stands in each lang, over all texts: lang, word, n."""
    return docs.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hashed(words: list[str], seed: int) -> np.ndarray:
    """Ids of words beyond a broadcast dictionary; 0 is kept for no word."""
    got = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words)).astype(np.int64)
    got[got == 0] = 1
    return got


def _seed(counts: DataFrame) -> int:
    """A seed under which no two words of the corpus share an id."""
    words = counts.select("word").distinct()

    def ids(seed: int) -> DataFrame:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([pa.array(_hashed(batch.column(0).to_pylist(), seed))], ["id"])

        return words.mapInArrow(of, "id long")

    seed = 0
    while not ids(seed).groupBy("id").count().where("count > 1").isEmpty():
        seed += 1
    return seed


def _projected(names, kind: type, seed: int):
    """A map over texts: for each lang and prefix of a step, the following words of all occurrences, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value if names is not None else None
        for step in steps(batches, "text", _STEP):
            pieces, (lang, langs) = Pieces(step.column("text")), _langs(step.column("lang"))
            coded = pieces.words.dictionary_encode()
            if known is not None:
                ids = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(kind) + 1
            else:
                ids = _hashed(coded.dictionary.to_pylist(), seed)
            word = ids[coded.indices.to_numpy(zero_copy_only=False)] if len(ids) else np.zeros(0, kind)
            n = len(word)
            follow, open_ = np.zeros((n, LONGEST - 1), kind), np.ones(n, bool)
            for k in range(1, LONGEST):
                m = max(0, n - k)
                open_[:m] &= pieces.goes_on[k - 1 : k - 1 + m] & (word[k:] != 0)
                open_[m:] = False
                follow[:m, k - 1] = np.where(open_[:m], word[k:], 0)
            used = np.flatnonzero((word != 0) & (follow[:, 0] != 0))
            prefix, of = word[used], lang[pieces.row[used]]
            order = np.lexsort((prefix, of))
            prefix, of, used = prefix[order], of[order], used[order]
            cut = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (of[1:] != of[:-1])]) if len(used) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[cut, len(used)])
            offsets = np.r_[0, np.cumsum(sizes)] * ((LONGEST - 1) * np.dtype(kind).itemsize)
            follows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(follow[used]))]).cast(pa.binary())
            heads = pa.FixedSizeListArray.from_arrays(pa.array(prefix[cut].astype(np.int64)), 1).cast(pa.list_(pa.int64()))
            yield pa.record_batch([langs.take(pa.array(of[cut])), heads, pa.array(sizes, pa.int64()), follows], ["lang", "prefix", "n", "follows"])

    return run


def _runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by value, and begin and size of each run of one value."""
    order = np.argsort(column, kind="stable")
    ordered = column[order]
    cut = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(column) else np.zeros(0, np.int64)
    return order, cut, np.diff(np.r_[cut, len(column)])


def _grow(prefix: tuple, follows: np.ndarray, least: int, found: list) -> None:
    """Extend to the right, depth-first: a frequent next word projects the occurrences that it holds."""
    if not follows.shape[1]:
        return
    order, cut, size = _runs(follows[:, 0])
    for at in np.flatnonzero(size >= least):
        word = int(follows[order[cut[at]], 0])
        if word:
            found.append((*prefix, word, int(size[at])))
            _grow((*prefix, word), follows[order[cut[at] : cut[at] + size[at]], 1:], least, found)


def _table(rows: list[tuple[str, list[int], int]]) -> pa.RecordBatch:
    langs, patterns, counts = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(langs, pa.string()), pa.array(patterns, pa.list_(pa.int64())), pa.array(counts, pa.int64())], ["lang", "prefix", "n"])


def _mined(kind: type, least: int):
    """A map over rows sorted by lang and prefix: the frequent extensions of each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> list:
            found: list[tuple] = []
            if at is not None:
                follows = np.concatenate([np.frombuffer(x, kind) for x in held])
                if len(follows):
                    _grow(at[1], follows.reshape(-1, LONGEST - len(at[1])), least, found)
            return [(at[0], list(x[:-1]), x[-1]) for x in found]

        for batch in batches:
            rows = []
            for lang, prefix, follows in zip(batch.column("lang").to_pylist(), batch.column("prefix").to_pylist(), batch.column("follows")):
                if (key := (lang, tuple(prefix))) != at:
                    rows += done()
                    at, held = key, []
                held.append(follows.as_buffer())
            held = [bytes(x) for x in held]  # the batch's memory goes
            yield _table(rows)
        yield _table(done())

    return run


def _extended(kind: type):
    """A map over the rows of large prefixes: one row for each next word, with what follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, prefixes, counts, follows = [], [], [], []
            for lang, prefix, blob in zip(batch.column("lang").to_pylist(), batch.column("prefix").to_pylist(), batch.column("follows")):
                width = LONGEST - len(prefix)
                at = np.frombuffer(blob.as_buffer(), kind).reshape(-1, width)
                order, cut, size = _runs(at[:, 0])
                for begin, n in zip(cut, size):
                    rows = order[begin : begin + n]
                    if word := int(at[rows[0], 0]):
                        langs.append(lang)
                        prefixes.append([*prefix, word])
                        counts.append(int(n))
                        rest = at[rows, 1:]
                        follows.append(rest[rest[:, 0] != 0].tobytes() if width > 1 else b"")
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(counts, pa.int64()), pa.array(follows, pa.binary())], ["lang", "prefix", "n", "follows"])

    return run


_PATTERN = "lang string, prefix array<long>, n long"
_ROWS = f"{_PATTERN}, follows binary"


def frequent_phrases(docs: DataFrame, counts: DataFrame, least: int = 30, prefix_rows: int = PREFIX_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Phrases of 1 to 4 words that stand at least ``least`` times in a lang: lang, phrase, words, f.

    ``counts`` is the stored word_counts(). Frequent words are numbered and broadcast while their
    counted rows and bytes are few; beyond, a word's id is a hash that no other word of the corpus has.
    """
    spark = docs.sparkSession
    words = counts.where(F.col("n") >= least).select("word").distinct()
    rows, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if few := rows <= broadcast_rows and size <= BROADCAST_BYTES:
        kind, seed = np.int32, 0
        known = pa.array(sorted(r.word for r in words.collect()), pa.large_string())
        names = spark.sparkContext.broadcast(known)
        ids = spark.createDataFrame(pa.table({"id": pa.array(np.arange(1, len(known) + 1)), "word": known.cast(pa.string())})) if len(known) else None
    else:
        kind, seed, names = np.int64, _seed(counts), None

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([pa.array(_hashed(batch.column(0).to_pylist(), seed)), batch.column(0)], ["id", "word"])

        ids = words.mapInArrow(hashed, "id long, word string")
    singles = counts.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"))
    if not rows:
        return singles
    state = stored(docs.select("lang", "text").mapInArrow(_projected(names, kind, seed), _ROWS), "occurrences")
    found, spent = [], [state]
    for width in range(1, LONGEST):
        sizes = stored(state.groupBy("lang", "prefix").agg(F.sum("n").alias("total")).where(F.col("total") >= least), "prefixes")
        spent.append(sizes)
        if width > 1:
            found.append(sizes.select("lang", "prefix", F.col("total").alias("n")))
        total, largest, many = sizes.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.max("total"), F.lit(0)), F.count("*")).first()
        if not many:
            break
        state = state.join(small(sizes, many), ["lang", "prefix"])
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_ROWS)
        cold = state.where(F.col("total") <= prefix_rows).select("lang", "prefix", "follows").repartition(parts, "lang", "prefix").sortWithinPartitions("lang", "prefix")
        found.append(cold.mapInArrow(_mined(kind, least), _PATTERN))
        if largest <= prefix_rows:
            break
        state = stored(state.where(F.col("total") > prefix_rows).select("lang", "prefix", "follows").mapInArrow(_extended(kind), _ROWS), "occurrences")
        spent.append(state)
        if width == LONGEST - 1:
            found.append(state.groupBy("lang", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    patterns = found[0]
    for more in found[1:]:
        patterns = patterns.unionByName(more)
    patterns = stored(patterns, "patterns")
    released(*spent)
    for k in range(LONGEST):
        patterns = patterns.join(small(ids.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"word{k}")), rows), F.get("prefix", F.lit(k)) == F.col(f"id{k}"), "left").drop(f"id{k}")
    phrase = F.concat_ws(" ", *[f"word{k}" for k in range(LONGEST)])
    return singles.unionByName(patterns.select("lang", phrase.alias("phrase"), F.size("prefix").alias("words"), F.col("n").alias("f")))


def _part(k: F.Column, n: F.Column | None = None) -> F.Column:
    words = F.split("phrase", " ")
    return F.concat_ws(" ", F.slice(words, k, F.size(words)) if n is None else F.slice(words, k, n))


def collocations(docs: DataFrame, least: int = 30, absorbed: int = 80, first: int = 2000, prefix_rows: int = PREFIX_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each lang's ``first`` phrases by score: lang, rank, phrase, a, l, r, n, score.

    A phrase that stands inside a longer candidate with at least ``absorbed`` percent of its count is left
    out. The report's length is the feature; all counts are whole. Products are decimals of 38 digits.
    """
    counts = stored(word_counts(docs), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    known = stored(frequent_phrases(docs, counts, least, prefix_rows, broadcast_rows), "phrases")  # grows with the corpus: never broadcast
    longer = known.where("words >= 2")
    # of each phrase the largest count of a longer candidate around it
    inner = F.expr(f"flatten(transform(sequence(2, {LONGEST - 1}), m -> if(m < words, transform(sequence(1, words - m + 1), k -> array_join(slice(split(phrase, ' '), k, m), ' ')), array())))")
    around = longer.where("words > 2").select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    kept = longer.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (wide("around") * 100 < wide("f") * absorbed))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumn("head", _part(F.lit(1), F.col("k"))).withColumn("tail", _part(F.col("k") + 1))
    side = lambda key, f: known.select("lang", F.col("phrase").alias(key), F.col("f").alias(f))
    scored = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    scored = scored.withColumn("score", F.expr("(cast(a as decimal(31,0)) * 2000000) div (cast(l as decimal(37,0)) + r)"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # limited before the shuffle, too
    ranked = worst.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first)
    return ranked.join(F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB, by counting every run of words.
ORACLE = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS t,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)),
runs AS (SELECT lang, m AS words, unnest(list_transform(generate_series(1, len(w) - m + 1), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS phrase
    FROM pieces, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE len(w) >= m),
counted AS (SELECT lang, words, phrase, count(*) AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang),
candidates AS (SELECT * FROM counted WHERE words >= 2 AND f >= 30),
inner_ AS (SELECT lang, f, unnest(list_transform(generate_series(1, words - m + 1), lambda k: array_to_string(string_split(phrase, ' ')[k:k + m - 1], ' '))) AS phrase
    FROM candidates, (VALUES (2), (3)) AS sizes(m) WHERE m < words),
around AS (SELECT lang, phrase, max(f) AS around FROM inner_ GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN around USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * f),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(generate_series(1, words - 1)) AS k FROM kept)),
scored AS (SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f + t.f))::BIGINT AS score
    FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
