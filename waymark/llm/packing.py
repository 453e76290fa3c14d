"""Operators 4 and 8: packing of token ids into windows of fixed length.

A text's ids and one end id are cut into whole windows and a remainder. How the remainders
share windows depends only on how many there are of each length, a table of at most
``capacity`` counts, whatever the size of the corpus. The plan, a list of (pattern, copies), is
made from that table; each piece finds its place from its rank among pieces of its length.
The ranks come from counts per task and length, so nothing is sorted or gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Counters, steps, stored, with_ranks
from waymark.llm.tokens import ENCODED_BYTES, encoder

#: lengths of a window's pieces with their numbers, and how many windows are filled alike
Plan = list[tuple[list[tuple[int, int]], int]]


def min_bin_slack(counts: dict[int, int], capacity: int) -> Plan:
    """Minimum bin slack: each window takes the longest remainder and the best company for it.

    A subset-sum over the multiset of remaining lengths, as bits of one integer, finds the sum
    closest to the capacity; backtracking through the steps gives the numbers. The same choice
    is repeated while the remaining numbers allow, so the work doesn't grow with the counts.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    plan: Plan = []
    while left:
        longest = max(left)
        room = capacity - longest
        mask = (1 << (room + 1)) - 1
        reach, trail = 1, []
        for n in sorted((n for n in left if n <= room), reverse=True):
            have = min(left[n] - (n == longest), room // n)
            part = 1
            while have > 0:  # 1, 2, 4, ... copies give every number up to have
                take = min(part, have)
                trail.append((n, take, reach))
                reach |= (reach << (n * take)) & mask
                have, part = have - take, part * 2
            if reach >> room & 1:
                break
        rest = reach.bit_length() - 1
        used = {longest: 1}
        for n, take, before in reversed(trail):
            if not before >> rest & 1:
                used[n] = used.get(n, 0) + take
                rest -= n * take
        copies = min(left[n] // k for n, k in used.items())
        plan.append((sorted(used.items(), reverse=True), copies))
        for n, k in used.items():
            left[n] -= k * copies
            if not left[n]:
                del left[n]
    return plan


class CapacityTree:
    """Segment tree over remaining capacities: how many windows have each, and the best fit."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.total = [0] * (2 * self.size)

    def add(self, room: int, windows: int) -> None:
        at = room + self.size
        while at:
            self.total[at] += windows
            at //= 2

    def best_fit(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that a window has."""
        at = length + self.size
        if self.total[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.total[at + 1]:
                at += 1
                while at < self.size:
                    at *= 2
                    if not self.total[at]:
                        at += 1
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on counts: equal windows are filled alike, all at once."""
    tree, alike = CapacityTree(capacity), {}

    def put(room: int, pattern: list[tuple[int, int]], windows: int) -> None:
        if windows:
            alike.setdefault(room, []).append((pattern, windows))
            tree.add(room, windows)

    for n in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        left = counts[n]
        while left:
            room = tree.best_fit(n)
            if room is None:  # as many new windows as it takes
                room, pattern, windows = capacity, [], -(-left // (capacity // n))
            else:
                pattern, windows = alike[room].pop()
                tree.add(room, -windows)
            fit = room // n
            full = min(windows, left // fit)
            put(room - fit * n, [*pattern, (n, fit)], full)
            left -= full * fit
            windows -= full
            if windows and left:
                put(room - left * n, [*pattern, (n, left)], 1)
                left, windows = 0, windows - 1
            if windows and pattern:
                put(room, pattern, windows)
    return [(pattern, windows) for groups in alike.values() for pattern, windows in groups]


def places(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, per window, first sequence, offset) of each run of pieces."""
    out, next_rank, sequence = [], {}, 0
    for pattern, copies in plan:
        offset = 0
        for n, k in pattern:
            low = next_rank.get(n, 0)
            next_rank[n] = low + k * copies
            out.append((n, low, low + k * copies, k, sequence, offset))
            offset += n * k
        sequence += copies
    return out


def pieces(docs: DataFrame, path: str, word: bool, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Stored pieces: doc_id, start, length, ids_crc32, doc_tokens, task_id, task_row and, if asked, ids.

    ``ids`` holds little-endian unsigned integers, of 16 bits if every id of the vocabulary fits.
    """

    def cut(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), Counters()
        encode = encoder(path, word)
        for batch in steps(batches, size=ENCODED_BYTES, kind="ids"):
            ids, offs = encode.ids(batch.column("text"))
            ids = np.insert(ids, offs[1:], end_id).astype("<u4")
            offs = offs + np.arange(len(offs))
            size = np.diff(offs)
            parts = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), parts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
            length = np.minimum(capacity, size[doc] - start)
            begin = offs[:-1][doc] + start
            spans = list(zip(begin.tolist(), (begin + length).tolist()))
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length)]
            columns += [pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64()), pa.array(size[doc])]
            columns += [pa.array(np.full(len(doc), task, np.int64)), pa.array(seen.number(length))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task_id", "task_row"]
            if with_ids:
                narrow = ids.astype("<u2") if encode.tokenizer.get_vocab_size() <= 1 << 16 else ids
                columns.append(pa.array([narrow[a:b].tobytes() for a, b in spans], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task_id long, task_row long"
    return stored(docs.select("doc_id", "text").mapInArrow(cut, schema + ", ids binary" * with_ids), "pieces", "zstd")  # ids take most of the disk


def placed(cut: DataFrame, pack: Callable[[dict[int, int], int], Plan], capacity: int) -> DataFrame:
    """The pieces with sequence_id and offset. Only the counts of each length reach the driver."""
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(pack(counts, capacity))
    spark = cut.sparkSession
    columns = zip(*table) if table else [()] * 6
    names = ["length", "low", "high", "per", "first", "base"]
    runs = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names))  # a few rows for each length at most; Arrow needs no Python workers
    found = with_ranks(cut, "length").join(F.broadcast(runs), "length").where("rank >= low and rank < high")
    at = F.col("rank") - F.col("low")
    found = found.withColumn("sequence_id", F.col("first") + F.floor(at / F.col("per")))
    found = found.withColumn("offset", F.col("base") + at % F.col("per") * F.col("length"))
    return found.drop("rank", "low", "high", "per", "first", "base", "task_id", "task_row")


def packed(docs: DataFrame, path: str, word: bool = True, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts hold their end id alone. Repeated rows and null ids are packed like any
    others, an empty table gives no rows, and other columns of ``docs`` are not read.
    """
    return placed(pieces(docs, path, word, capacity, end_id, with_ids=False), min_bin_slack, capacity)


def matrix(docs: DataFrame, path: str, word: bool = False, capacity: int = 2048, end_id: int = 50256) -> DataFrame:
    """Packed id rows by best-fit decreasing: sequence_id, ids, cu_seqlens, position_resets, n_tokens, doc_ids.

    ``ids`` is the row of the id matrix, ``capacity`` little-endian unsigned integers (16 bits if
    the vocabulary fits, else 32) padded with ``end_id``; ``cu_seqlens`` the cumulative lengths of
    its segments from 0; ``position_resets`` the offsets at which positions begin again at 0, the
    padding's included; ``doc_ids`` the document of each segment. A document longer than a row is
    split over several rows, in order of its pieces and without loss. Edge cases as in packed().
    """
    cut = pieces(docs, path, word, capacity, end_id, with_ids=True)
    rows = placed(cut, best_fit_decreasing, capacity).select("sequence_id", "offset", "length", "doc_id", "start", "ids")
    rows = rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    names = ["sequence_id", "ids", "cu_seqlens", "position_resets", "n_tokens", "doc_ids", "starts"]

    def build(batches):
        held: list[tuple] = []

        def row(group: list[tuple]) -> tuple:
            ids = b"".join(g[5] for g in group)
            total = sum(g[2] for g in group)
            width = len(ids) // total
            ids += int(end_id).to_bytes(width, "little") * (capacity - total)
            offsets = [g[1] for g in group]
            resets = offsets + [total] * (total < capacity)
            return group[0][0], ids, [*offsets, total], resets, total, [g[3] for g in group], [g[4] for g in group]

        def flush(rows: list[tuple]):
            types = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        out: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "offset", "length", "doc_id", "start", "ids"))):
                if held and held[0][0] != r[0]:
                    out.append(row(held))
                    held = []
                held.append(r)
            if len(out) >= 1024:
                yield flush(out)
                out = []
        if held:
            out.append(row(held))
        if out:
            yield flush(out)

    schema = "sequence_id long, ids binary, cu_seqlens array<int>, position_resets array<int>, n_tokens long, doc_ids array<long>, starts array<long>"
    return rows.mapInArrow(build, schema)


def write_matrix(rows: DataFrame, path: str) -> None:
    """Write matrix() rows as Parquet, the ids of a row as one value of fixed width."""
    rows.write.mode("overwrite").parquet(path)


def id_matrices(files: list[str], capacity: int = 2048):
    """(id matrix, cu_seqlens of its rows, position_resets of its rows) of each batch of rows in files of write_matrix(), as a trainer reads them."""
    import pyarrow.parquet as pq

    for file in files:
        for batch in pq.ParquetFile(file).iter_batches(columns=["ids", "cu_seqlens", "position_resets"]):
            raw = b"".join(batch.column("ids").to_pylist())
            width = len(raw) // max(batch.num_rows * capacity, 1) or 4
            yield np.frombuffer(raw, f"<u{width}").reshape(batch.num_rows, capacity), batch.column("cu_seqlens").to_pylist(), batch.column("position_resets").to_pylist()
