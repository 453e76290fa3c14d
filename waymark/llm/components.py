"""Distributed connected components (alternating large-star and small-star), DataFrames only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import released, stored


#: Edges of a chunk that a task connects at once.
CHUNK = 250_000


def _stars(edges: DataFrame, chunks: int) -> DataFrame:
    """Edges dealt over chunks of about CHUNK, each replaced by edges from its nodes to the smallest of their component."""

    def run(batches):
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        nodes, ends = np.unique(np.stack([np.concatenate(x) for x in zip(*parts)]), return_inverse=True)
        one, two = ends.reshape(2, -1)
        root = np.arange(len(nodes))
        while True:  # both ends take the smaller root, then every node its root's
            low = np.minimum(root[one], root[two])
            new = root.copy()
            for at in (root[one], root[two], one, two):
                np.minimum.at(new, at, low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        far = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["u", "v"])

    return edges.repartition(chunks, "u").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, native: bool = True) -> DataFrame:
    """Smallest reachable node of every node of ``edges`` (src, dst): columns node, component.

    Nodes are of any orderable type. Self-loops and repeated edges are allowed; edges with a
    null end are ignored; an empty input gives an empty result. Each round is a few joins and
    aggregations over pairs of nodes; a hub's least neighbour is found by partial aggregation, and
    adaptive execution splits the join of a hub with many edges. Rounds grow with the logarithm
    of the longest chain. The result is a stored table. Unless ``native``, nodes are numbers and
    chunks of edges are first contracted inside tasks, which leaves few rounds; one chunk leaves none.
    """
    larger = F.greatest("src", "dst").alias("u")
    smaller = F.least("src", "dst").alias("v")
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    now = stored(edges.where("src <> dst").select(larger, smaller).distinct(), "edges")
    mark = _mark(now)
    whole = False
    if not native and mark[0]:
        chunks = -(-mark[0] // CHUNK)
        before, now = now, stored(_stars(now, chunks), "edges")
        released(before)
        mark, whole = _mark(now), chunks == 1
    while mark[0] and not whole:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        star = star.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stored(star, "edges")
        released(before)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    # every node now hangs on the smallest one of its component
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    alone = loops.select("node", F.col("node").alias("component"))
    out = stored(out.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component")), "components")
    released(now)
    return out


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free checksum of the edges."""
    got = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
    return got[0], got[1]
