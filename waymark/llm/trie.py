"""Prefix trie of rebuilt conversations in preorder intervals.

A turn is the digest of its role and text. Turns are gathered in blocks of 16, blocks in blocks of
blocks, until each conversation is one; distinct blocks are ranked lexicographically at each step,
so conversations of any length compare by one short key and no row or group holds more than 16
parts. Sorted by that key, the members of a node are neighbours: a node is its depth and the
first and last conversation that begin with it. On the way back down each prefix gets its digest,
which names its node. In preorder (first conversation, depth) a subtree is one interval; leaves and
savings of a subtree are differences of running sums at the interval's two ends, found in one
sort of starts and ends, without a join on a key that many nodes share.

Defined cases: rows without a conv_id take no part; a null turn comes first; turns that tie are
ordered by the digest of role and text, and equal rows all stay; null role or text is empty; a
negative conv_id takes its remainder as SQL does (sign of the dividend); an empty table has no
node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import released, stored
from waymark.llm.ordered import looked_up, running

#: Parts of a block.
BLOCK = 16
_END = 1 << 62


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def turns(conversations: DataFrame) -> DataFrame:
    """Each turn as digest and number of words: conv_id, turn, part, words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    part = _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), part.alias("part"), words.cast("long").alias("words"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations, and their rebuilt turns with gapless depths from 1.

    ``own`` holds the original turns with their number from 1. A first conversation lends at most
    three turns to at most twenty others.
    """
    lent = F.crc32(F.col("conv_id").cast("string")) % 4
    every = own.where("number = 1").select("conv_id", lent.alias("lent"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    heads = own.where("number <= 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "number", "part", "words")
    borrowed = every.join(heads, "base").where("number <= lent").select("conv_id", "number", "part", "words")
    kept = own.where(F.col("number") > lent).select("conv_id", "number", "part", "words")
    return every.select("conv_id"), running(borrowed.unionByName(kept), "conv_id", ["number"], {"depth": F.lit(1)})


def _blocks(parts: DataFrame) -> DataFrame:
    """Parts (conv_id, at from 0, part, words, deep) in blocks of 16: their list, key and greatest depth."""
    group = parts.groupBy("conv_id", F.expr(f"at div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "part", "words"))).alias("parts"), F.max("deep").alias("deep"))
    return group.withColumn("key", F.array_join(F.transform("parts", lambda x: x.part), ""))


def _prefix(size: Column) -> Column:
    """Name of a prefix: of what stands before the block (``up``) and the block's first parts.

    A whole block is named as the part that it is one step up (``through``), as the next block's ``up`` is.
    """
    own = F.array_join(F.transform(F.slice("parts", F.lit(1), size), lambda x: x.part), "")
    named = F.when((size == BLOCK) & F.col("through").isNotNull(), F.col("through")).otherwise(_digest(F.concat("up", F.lit(":"), own)))
    return F.when(size == 0, F.col("up")).otherwise(named)


def visits(conversations: DataFrame) -> DataFrame:
    """Each rebuilt conversation at each node: conv_id, place in lexicographic order, depth, node, parent, words, ends."""
    own = running(turns(conversations), "conv_id", ["turn", "part"], {"number": F.lit(1)})
    every, deep = rebuilt(own)
    levels = [stored(_blocks(deep.select("conv_id", (F.col("depth") - 1).alias("at"), "part", "words", F.col("depth").alias("deep"))), "blocks")]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        keys = running(levels[-1].groupBy("key").agg(F.count("*").alias("rows")).withColumn("all", F.lit(0).cast("long")), "all", ["key"], {"rank": F.lit(1)})
        names = stored(keys.select("key", F.lpad(F.hex("rank"), 16, "0").alias("part"), "rows"), "names")
        named = looked_up(levels[-1].select("conv_id", F.col("block").alias("at"), "deep", "key"), names, ["key"], "rows")
        levels.append(stored(_blocks(named.withColumn("words", F.lit(0).cast("long"))), "blocks"))
        released(names)
    top = every.join(levels[-1].select("conv_id", "key", "deep"), "conv_id", "left")
    sorted_ = running(top.select("conv_id", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("deep", F.lit(0)).cast("long").alias("turns"), F.lit(0).cast("long").alias("all")), "all", ["key", "conv_id"], {"place": F.lit(1)})
    placed = stored(sorted_.select("conv_id", "place", "turns"), "places")
    down = placed.select("conv_id", "place", "turns", F.lit(0).cast("long").alias("block"), F.lit("").alias("up"), F.lit(None).cast("string").alias("through"))
    for level in reversed(levels[1:]):
        rows = level.join(down, ["conv_id", "block"]).select("conv_id", "place", "turns", "up", "through", "parts", F.posexplode("parts").alias("k", "x"))
        down = rows.select("conv_id", "place", "turns", F.col("x.at").alias("block"), _prefix(F.col("k")).alias("up"), _prefix(F.col("k") + 1).alias("through"))
    rows = levels[0].join(down, ["conv_id", "block"]).select("conv_id", "place", "turns", "up", "through", "parts", F.posexplode("parts").alias("k", "x"))
    depth = F.col("x.at") + 1
    steps = rows.select("conv_id", "place", depth.alias("depth"), _prefix(F.col("k") + 1).alias("node"), _prefix(F.col("k")).alias("parent"), F.col("x.words").alias("words"), (depth == F.col("turns")).alias("ends"))
    roots = placed.select("conv_id", "place", F.lit(0).cast("long").alias("depth"), F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("words"), (F.col("turns") == 0).alias("ends"))
    found = stored(steps.unionByName(roots), "visits")
    released(*levels, placed)
    return found


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the conversations of each node, streamed in order: whatever their number, one hash state is held."""
    at, state, first = None, None, True
    for batch in batches:
        out = []
        for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, node) != at:
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state, first = (depth, node), hashlib.sha256(), True
            state.update(b"%d" % conv if first else b",%d" % conv)
            first = False
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.string(), pa.string()))], ["depth", "node", "ends_sha256"])
    if at is not None:
        yield pa.record_batch([pa.array([at[0]]), pa.array([at[1]]), pa.array([state.hexdigest()])], ["depth", "node", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, with its preorder interval.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, preorder, subtree_end (preorder number of the last node of the subtree).
    """
    seen = visits(conversations)
    nodes = seen.groupBy("depth", "node").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("parent").alias("parent"))
    nodes = stored(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    known = stored(nodes.join(children, ["depth", "node"], "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_convs": F.col("last") - F.col("first") + 1}), "known")
    parents = stored(known.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"), "parents")
    whole = looked_up(known, parents.withColumnRenamed("n_children", "rows"), ["depth", "parent"], "rows")

    starts = known.select("first", "depth", F.col("first").alias("at"), F.col("depth").alias("deep"), F.lit(1).alias("one"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saving"))
    ends = known.select("first", "depth", F.col("last").alias("at"), F.lit(_END).alias("deep"), F.lit(0).alias("one"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saving"))
    events = starts.unionByName(ends).withColumn("all", F.lit(0).cast("long"))
    sums = running(events, "all", ["at", "deep", "first", "depth"], {"nodes": F.col("one"), "leaves": F.col("leaf"), "savings": F.col("saving")})
    over = F.col("deep") == _END
    edge = lambda c, own: F.max(F.when(over, F.col(c))) - F.max(F.when(~over, F.col(c) - F.col(own)))
    spans = sums.groupBy("first", "depth").agg(edge("leaves", "leaf").alias("n_leaves"), edge("savings", "saving").alias("saved_tokens"), (F.max(F.when(~over, F.col("nodes"))) - 1).alias("preorder"), (F.max(F.when(over, F.col("nodes"))) - 1).alias("subtree_end"))

    digests = seen.where("ends").select("depth", "node", "conv_id").repartition("depth", "node").sortWithinPartitions("depth", "node", "conv_id").mapInArrow(_ends, "depth long, node string, ends_sha256 string")
    out = whole.join(spans, ["first", "depth"]).join(digests, ["depth", "node"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "preorder", "subtree_end")


#: The same nodes in DuckDB, each with its whole prefix as a list.
ORACLE = r"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, part) AS i, part, words
    FROM (SELECT conv_id, turn, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS part,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM conversations WHERE conv_id IS NOT NULL)),
every AS (SELECT c, c - c % 20 AS base, xor(crc, 4294967295) % 4 AS h FROM (SELECT c,
    list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT) AS crc
    FROM (SELECT DISTINCT conv_id AS c FROM own))),
turns AS (SELECT c, i, part, words FROM every JOIN own ON own.conv_id = base WHERE i <= h UNION ALL SELECT c, i, part, words FROM every JOIN own ON own.conv_id = c WHERE i > h),
seqs AS (SELECT c, coalesce(list({'p': part, 'w': words} ORDER BY i) FILTER (part IS NOT NULL), []) AS s FROM every LEFT JOIN turns USING (c) GROUP BY c),
steps AS (SELECT c, unnest(generate_series(0, len(s))) AS d, s FROM seqs),
nodes AS (SELECT d, s[1:d] AS p, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(s[d].w), 0) AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends_sha256 FROM (SELECT c, d, s FROM steps) GROUP BY d, s[1:d]),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (d, p)),
under AS (SELECT k AS d, p[1:k] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(generate_series(0, d)) AS k FROM whole) GROUP BY ALL)
SELECT w.conv_id, w.d::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256,
    row_number() OVER (ORDER BY list_transform(w.p, lambda x: x.p)) - 1 AS preorder, row_number() OVER (ORDER BY list_transform(w.p, lambda x: x.p)) - 2 + size AS subtree_end
FROM whole w JOIN under USING (d, p) LEFT JOIN nodes up ON up.d = w.d - 1 AND up.p = w.p[1:w.d - 1]
    JOIN (SELECT k AS d, p[1:k] AS p, count(*) AS size FROM (SELECT *, unnest(generate_series(0, d)) AS k FROM whole) GROUP BY ALL) sizes USING (d, p)
"""
