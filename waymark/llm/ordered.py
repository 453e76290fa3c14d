"""Running sums over a sorted table without a task that holds a whole key, and lookups of hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import BROADCAST_ROWS, stored

#: At most so many keys of a lookup are broadcast as hot ones.
HOT_KEYS = 10_000
#: A key with fewer rows isn't hot.
HOT_ROWS = 100_000


def _summed(key: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry, task = None, dict.fromkeys(names, 0), TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[cut, len(keys)])
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n not in names]
            kept = [n for n in batch.schema.names if n not in names]
            for name in names:
                total = np.cumsum(batch.column(name).to_numpy(zero_copy_only=False))
                before = np.r_[0, total][cut]
                if keys[0] == last:
                    before[0] -= carry[name]
                total = total - np.repeat(before, sizes)
                carry[name] = int(total[-1])
                columns.append(pa.array(total, pa.int64()))
            last = keys[-1]
            yield pa.record_batch([*columns, pa.array(np.full(len(keys), task), pa.int32())], [*kept, *names, "task_of_sum"])

    return run


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df``, stored, with each of ``sums`` added up, the row included, within ``key`` (a long) in the given order.

    Rows are sorted by ranges of key and order, so a key with many rows spreads over tasks. Each task
    adds up what it has; a key that goes on in later tasks gets the sums of the earlier ones from a table
    of at most one row for each task. Values must not be negative. Rows that are equal in key and order
    are taken in any order.
    """
    cols = [key, *order]
    wide = df.withColumns({n: c.cast("long") for n, c in sums.items()})
    rest = [f for f in wide.schema.fields if f.name not in sums]
    schema = T.StructType([*rest, *[T.StructField(n, T.LongType()) for n in sums], T.StructField("task_of_sum", T.IntegerType())])
    placed = stored(wide.select(*[f.name for f in rest], *sums).repartitionByRange(*cols).sortWithinPartitions(*cols).mapInArrow(_summed(key, list(sums)), schema), "running")
    before = Window.partitionBy(key).orderBy("task_of_sum").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(key, "task_of_sum").agg(*[F.max(n).alias(n) for n in sums])
    carried = totals.select(key, "task_of_sum", *[F.sum(n).over(before).alias(f"{n}_before") for n in sums]).where(F.col(f"{next(iter(sums))}_before").isNotNull())
    found = placed.join(F.broadcast(carried), [key, "task_of_sum"], "left")  # a key crosses into a task at most once
    return found.select(*[f.name for f in rest], *[(F.col(n) + F.coalesce(f"{n}_before", F.lit(0))).alias(n) for n in sums])


def looked_up(df: DataFrame, table: DataFrame, on: list[str], rows: str) -> DataFrame:
    """Left join of ``df`` with a stored ``table`` that is unique by ``on`` and says how many ``rows`` of ``df`` each key has.

    A table counted small is broadcast. Else the keys that hold most are: at most ``HOT_KEYS`` keys
    can have more than a ten-thousandth of all rows. The other keys are shuffled.
    """
    many, total = table.agg(F.count("*"), F.coalesce(F.sum(rows), F.lit(0))).first()
    if many <= BROADCAST_ROWS:
        return df.join(F.broadcast(table.drop(rows)), on, "left")
    edge = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = F.broadcast(table.where(F.col(rows) > edge).drop(rows)), table.where(F.col(rows) <= edge).drop(rows)
    return df.join(hot, on).unionByName(df.join(hot, on, "left_anti").join(cold, on, "left").select(*df.join(hot, on).columns))


