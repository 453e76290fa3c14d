"""Operator 7: balanced label propagation.

Documents of equal text are linked. Each starts in a shard by hash; in every round the groups that aren't
settled ask for the shard where most of their documents lie among those with room for them, and
a shard takes them, largest first, as far as its quota goes, until no group is left. Groups of a
sixteenth of a shard or more are so few that they are planned one by one beforehand, the largest
first, over as few shards as hold them. Documents move once, when their group's shard is known. A
last step evens the counts out exactly, with unlinked documents first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import Counters, released, stored, with_ranks
from waymark.llm.ordered import running

#: A group of more than this part of a shard is planned by itself: at most LARGE groups a shard can be.
LARGE = 16
#: Groups of copies up to which a row of each is broadcast; beyond, groups are joined under SALTS keys each.
BROADCAST_GROUPS = 100_000
SALTS = 16


def _rows(docs: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.md5(text).alias("text_key"),
        F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"),
    )


def _with_group(rows: DataFrame, groups: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with the ``n`` rows of ``groups`` on text_key, such that no task gets all rows of a large group."""
    if n <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), "text_key", how)
    salted = groups.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", F.lit(3)), F.lit(SALTS)).cast("int"))
    return met.join(salted, ["text_key", "salt"], how).drop("salt")


def _planned(sizes: list[int], room: list[int], capacity: int) -> list[list[tuple[int, int]]]:
    """(shard, documents) of each group, largest first: whole where it fits most tightly, else the emptiest shards are filled up."""
    out = []
    for size in sizes:
        parts = []
        while size > 0 and any(r > 0 for r in room):
            fits = [s for s, r in enumerate(room) if r >= size]
            at = min(fits, key=lambda s: (room[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
            n = min(size, room[at])
            parts.append((at, n))
            room[at] -= n
            size -= n
        if size > 0:  # nothing is left: what is over goes to the last shard and is evened out
            parts.append((parts[-1][0] if parts else 0, size))
        out.append(parts)
    return out


def _settled(groups: DataFrame, room: list[int]) -> DataFrame:
    """text_key, target: a shard for each group, as far as the room goes; ``groups``: text_key, total, cells (n, shard)."""
    open_, found = groups.select("text_key", "total", "cells").withColumn("turn", F.lit(0)), None
    for turn in range(2 * len(room) + 2):
        rooms = F.array(*map(F.lit, room))
        has = F.filter("cells", lambda c: F.get(rooms, c["shard"]) >= F.col("total"))
        best = F.array_max(F.transform(has, lambda c: F.struct(c["n"].alias("n"), (-c["shard"]).alias("back"))))
        other = F.filter(F.array(*map(F.lit, range(len(room)))), lambda s: F.get(rooms, s) >= F.col("total"))
        pick = F.get(other, F.pmod(F.xxhash64("text_key", F.lit(turn)), F.size(other)).cast("int"))
        aim = F.when(F.size(has) > 0, -best["back"]).when(F.size(other) > 0, pick)
        asked = running(open_.withColumn("aim", F.coalesce(aim, F.lit(-1)).cast("long")).withColumn("less", -F.col("total")), "aim", ["less", "text_key"], {"upto": F.col("total")})
        asked = stored(asked.withColumn("taken", (F.col("aim") >= 0) & (F.col("upto") <= F.get(rooms, F.col("aim").cast("int")))), "asked")
        mine = asked.where("taken").select("text_key", F.col("aim").cast("int").alias("target"))
        found = mine if found is None else found.unionByName(mine)
        used = {r.aim: r.n for r in asked.where("taken").groupBy("aim").agg(F.sum("total").alias("n")).collect()}  # a row for each shard at most
        room = [r - used.get(s, 0) for s, r in enumerate(room)]
        open_ = asked.where("not taken").select("text_key", "total", "cells")
        if not used or open_.isEmpty():
            break
    # no shard has room for the whole of what is left: it stays where most of it lies and is evened out
    most = F.array_max(F.transform("cells", lambda c: F.struct(c["n"].alias("n"), (-c["shard"]).alias("back"))))
    return found.unionByName(open_.select("text_key", (-most["back"]).cast("int").alias("target")))


def propagated(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """``rows`` with linked and the shard that label propagation gives."""
    cells = rows.groupBy("text_key", "shard").agg(F.count("*").alias("n"))
    groups = cells.groupBy("text_key").agg(F.sum("n").alias("total"), F.collect_list(F.struct("n", "shard")).alias("cells"))  # a cell for each shard at most
    groups = stored(groups.where("total > 1"), "groups")
    capacity = total // shards
    large = groups.where(F.col("total") * LARGE > capacity).select("text_key", "total").orderBy(F.desc("total"), "text_key").collect()
    room = [capacity] * shards
    plans = _planned([r.total for r in large], room, capacity)
    spark = rows.sparkSession
    planned = spark.createDataFrame([(r.text_key, i, None) for i, r in enumerate(large)], "text_key string, plan long, target int")
    settled = stored(_settled(groups.where(F.col("total") * LARGE <= capacity), room).select("text_key", F.lit(None).cast("long").alias("plan"), "target").unionByName(planned), "settled")
    placed = stored(_with_group(rows, settled, settled.count(), "left"), "linked")
    quotas, low = [], {}
    for plan, parts in enumerate(plans):
        for shard, n in parts:
            quotas.append((plan, low.get(plan, 0), low.get(plan, 0) + n, shard))
            low[plan] = low.get(plan, 0) + n
    quota = F.broadcast(spark.createDataFrame(quotas, "plan long, low long, high long, goal int"))  # a few for each shard
    ranked = with_ranks(_numbered(placed.where("plan is not null").drop("target"), "plan"), "plan").drop("task_id", "task_row")
    spread = ranked.join(quota, (ranked.plan == quota.plan) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    columns = [c for c in rows.columns if c != "shard"]
    moved = spread.select(*columns, F.col("goal").alias("shard"), F.lit(True).alias("linked"))
    rest = placed.where("plan is null").select(*columns, F.coalesce("target", "shard").alias("shard"), F.col("target").isNotNull().alias("linked"))
    return moved.unionByName(rest)


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """Stored rows with task_id and task_row: a number within each key inside a task."""
    schema = T.StructType([*rows.schema.fields, T.StructField("task_id", T.LongType()), T.StructField("task_row", T.LongType())])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), Counters()
        for batch in batches:
            number = seen.number(batch.column(key).to_numpy())
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, task, np.int64)), pa.array(number)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "task_id", "task_row"])

    return stored(rows.mapInArrow(run, schema), "numbered")


def _evened(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """Shards whose counts are at most one apart; unlinked documents leave a full shard first."""
    caps = [total // shards + (i < total % shards) for i in range(shards)]
    kinds = {(r.shard, r.linked): r.n for r in rows.groupBy("shard", "linked").agg(F.count("*").alias("n")).collect()}
    loads = [kinds.get((s, True), 0) + kinds.get((s, False), 0) for s in range(shards)]
    # ranks run over linked documents first, so those beyond the quota are unlinked ones if any
    coded = rows.withColumn("class", (F.col("shard") * 2 + F.when(F.col("linked"), 0).otherwise(1)).cast("int"))
    ranked = with_ranks(_numbered(coded, "class"), "class").drop("task_id", "task_row", "class")
    before = F.element_at(F.array(*[F.lit(kinds.get((s, True), 0)) for s in range(shards)]), F.col("shard") + 1)
    ranked = ranked.withColumn("place", F.col("rank") + F.when(F.col("linked"), 0).otherwise(before)).drop("rank")
    cap = F.element_at(F.array(*map(F.lit, caps)), F.col("shard") + 1)
    # the surplus of all shards in one row of numbers, cut into the gaps of the others
    surplus = [max(0, n - c) for n, c in zip(loads, caps)]
    start = np.r_[0, np.cumsum(surplus)][:-1].tolist()
    number = F.col("place") - cap + F.element_at(F.array(*[F.lit(int(x)) for x in start]), F.col("shard") + 1)
    moved, slot, low = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s, (n, c) in enumerate(zip(loads, caps)):
        if n < c:
            inside = (number >= low) & (number < low + c - n)
            moved, slot = F.when(inside, s).otherwise(moved), F.when(inside, number - low + n).otherwise(slot)
            low += c - n
    stays = F.col("place") < cap
    return ranked.select("doc_id", "size", "text_crc32", F.when(stays, F.col("shard")).otherwise(moved).alias("shard"), F.when(stays, F.col("place")).otherwise(slot).cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: counts of the shards are at most one apart. ``slot`` numbers a shard's
    documents from 0 without gaps. Null texts count as empty, so null and empty texts are linked;
    repeated rows and null ids are placed like any others; an empty table gives no rows. A group
    of copies larger than a shard is spread over as few shards as hold it, or one more. Texts of any length are
    read whole, once; other columns are not read.
    """
    rows = stored(_rows(docs.select("doc_id", "text"), shards), "rows")
    total = rows.count()
    out = _evened(stored(propagated(rows, shards, total), "propagated"), shards, total)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
