"""Operator 9: approximate nearest neighbours by a robust-pruned directed graph per shard.

Distinct vectors are dealt to shards of bounded size. In each shard greedy searches propose
neighbours for every vector, relaxed distance pruning keeps diverse edges, and the graph is
stored. Queries, in blocks, run a beam search in every shard; the proposals are scored exactly
in double precision on the original vectors and the best of all shards are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import stored

SHARD_ROWS = 4000
QUERY_BLOCK = 2000
DEGREE = 24
#: Nodes that a walk keeps while the graph is built, and while queries are answered.
BEAM = 64
QUERY_BEAM = 128
#: A candidate is dropped when a chosen neighbour is this many times nearer to it than the node.
RELAX = 1.2
BATCH = 256


def beam_search(unit: np.ndarray, edges: np.ndarray, start: int, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances (1 - cosine) of the ``beam`` nearest nodes found for each asked unit vector.

    All asked vectors walk together: each step expands everyone's nearest unexpanded node.
    ``edges`` is nodes x degree, padded with -1.
    """
    m = len(asked)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = 1 - asked @ unit[start]
    rows = np.arange(m)
    while len(rows):
        open_dist = np.where(done[rows], np.inf, dist[rows])
        pick = open_dist.argmin(1)
        rows, pick = (x[np.isfinite(open_dist[np.arange(len(rows)), pick])] for x in (rows, pick))
        if not len(rows):
            break
        done[rows, pick] = True
        near = edges[ids[rows, pick]]
        far = np.einsum("md,mkd->mk", asked[rows], unit[np.maximum(near, 0)])
        far = np.where(near >= 0, 1 - far, np.inf)
        known = (near[:, :, None] == ids[rows][:, None, :]).any(2)
        far[known] = np.inf
        all_ids = np.concatenate([ids[rows], near], 1)
        all_dist = np.concatenate([dist[rows], far], 1)
        all_done = np.concatenate([done[rows], ~np.isfinite(far)], 1)
        best = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        ids[rows] = np.take_along_axis(all_ids, best, 1)
        dist[rows] = np.take_along_axis(all_dist, best, 1)
        done[rows] = np.take_along_axis(all_done, best, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(unit: np.ndarray, node: int, candidates: np.ndarray, degree: int = DEGREE, relax: float = RELAX) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of a node among the candidates, nearest first."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != node)])
    vectors = unit[candidates]
    dist = 1 - vectors @ unit[node]
    order = np.argsort(dist, kind="stable")
    candidates, vectors, dist = candidates[order], vectors[order], dist[order]
    between = 1 - vectors @ vectors.T
    alive = np.ones(len(candidates), bool)
    chosen = []
    for i in range(len(candidates)):
        if alive[i]:
            chosen.append(i)
            if len(chosen) == degree:
                break
            alive &= relax * between[i] > dist
    return candidates[chosen]


def build_graph(unit: np.ndarray, seed: int = 1) -> tuple[np.ndarray, int]:
    """Neighbour table (nodes x DEGREE, padded with -1) and the start node."""
    n = len(unit)
    start = int(np.argmax(unit @ unit.mean(0)))
    wide = DEGREE + DEGREE // 2  # room for reverse edges before a node is pruned again
    edges = np.full((n, wide), -1, np.int64)
    count = np.zeros(n, np.int64)
    random = np.random.RandomState(seed)
    if n <= DEGREE + 1:
        for i in range(n):
            edges[i, : n - 1] = [j for j in range(n) if j != i]
        return edges[:, :DEGREE], start
    edges[:, :8] = random.randint(0, n, (n, 8))
    count[:] = 8
    for sweep in range(2):
        order = random.permutation(n)
        for a in range(0, n, BATCH):
            batch = order[a : a + BATCH]
            found, _ = beam_search(unit, edges, start, unit[batch], BEAM if sweep else BEAM // 2)
            back: dict[int, list[int]] = {}
            for node, proposed in zip(batch, found):
                kept = robust_prune(unit, node, np.r_[proposed, edges[node, : count[node]]])
                edges[node] = -1
                edges[node, : len(kept)], count[node] = kept, len(kept)
                for j in kept.tolist():
                    back.setdefault(j, []).append(node)
            for j, new in back.items():
                both = np.r_[edges[j, : count[j]], new]
                if len(both) > wide:
                    both = robust_prune(unit, j, both)
                edges[j] = -1
                edges[j, : len(both)], count[j] = both, len(both)
    for j in np.flatnonzero(count > DEGREE):
        kept = robust_prune(unit, j, edges[j, : count[j]])
        edges[j] = -1
        edges[j, : len(kept)] = kept
    return edges[:, :DEGREE], start


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, dim of the vectors that take part: not null or zero, all parts finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", "embedding", F.size("embedding").alias("dim")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)


def graphs(vectors: DataFrame, k: int) -> DataFrame:
    """Stored graph rows: dim, shard, at, start, embedding, ids (the k + 1 smallest of equal vectors), near."""
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    some = vectors.distinct().withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    nodes = stored(some.groupBy("dim", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, math.ceil(nodes.count() / SHARD_ROWS))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort([x[0] for x in table.column("ids").to_pylist()], kind="stable")))
        x = _matrix(table.column("embedding"), table.column("dim")[0].as_py())
        edges, start = build_graph(_unit(x))
        n = len(x)
        return pa.table({"dim": table.column("dim"), "shard": table.column("shard"), "at": pa.array(np.arange(n)), "start": pa.array(np.full(n, start)), "embedding": table.column("embedding"), "ids": table.column("ids"), "near": pa.array(list(edges), pa.list_(pa.int64()))})

    kind = dict(vectors.dtypes)["embedding"]
    return stored(nodes.groupBy("dim", "shard").applyInArrow(build, f"dim int, shard int, at long, start long, embedding {kind}, ids array<long>, near array<long>"), "graphs")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each query's k nearest found, nearest first, ties to smaller ids: query_id, rank, vec_id, score.

    The score is the cosine in double precision on the original vectors. Vectors that are null,
    zero or hold null or non-finite components take no part, on either side; only vectors of the
    query's length are its candidates; rows of the query's own id are none; rows that repeat an id
    count once. Other columns are not read.
    """
    graph = graphs(usable(vectors), k)
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), "dim")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    parts = graph.groupBy(F.col("dim").alias("dim"), F.col("shard").alias("part")).count()  # a row for thousands of vectors
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).join(parts, "dim")
    asked = asked.select("query_id", "asked", "dim", F.col("part").alias("shard"), "block")
    held = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(nodes: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not nodes.num_rows or not wanted.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        nodes = nodes.sort_by("at")
        dim = nodes.column("dim")[0].as_py()
        x, q = _matrix(nodes.column("embedding"), dim), _matrix(wanted.column("asked"), dim)
        edges = nodes.column("near").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        found, _ = beam_search(_unit(x), edges, nodes.column("start")[0].as_py(), _unit(q), QUERY_BEAM)
        ids, own = nodes.column("ids").to_pylist(), wanted.column("query_id").to_pylist()
        size = np.sqrt((x * x).sum(1))
        out: list[tuple] = []
        for i, row in enumerate(found):
            row = row[row >= 0]
            score = (x[row] * q[i]).sum(1) / (size[row] * np.sqrt((q[i] * q[i]).sum()))
            best = [(-s, v) for s, at in zip(score.tolist(), row.tolist()) for v in ids[at] if v != own[i]]
            out += [(own[i], v, -s) for s, v in sorted(best)[:k]]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))] if out else [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)

    keys = ["dim", "shard", "block"]
    got = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    got = got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
