"""Shared pieces of the corpus operators: durable intermediate tables, Arrow text buffers, ranks.

Intermediate results that are read twice are written as Parquet under the folder that the
cluster names in ``spark.checkpoint.dir``; that cuts lineage and survives lost executors.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of eight or so bytes each that may be broadcast: about 32 MB. Larger sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Text bytes that a numpy step handles at once; a longer single text forms a step of its own.
STEP_BYTES = 2 << 20
#: Bytes of an Arrow batch (small_batches()): a task holds it in the writing buffers of the JVM and its Python worker holds it again.
BATCH_BYTES = 4_000_000
#: What a Python worker remembers from task to task, by kind of work; see steps().
HELD: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; without one, a local one for a local master and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and return it read back, with its lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/waymark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Empty the folders of stored() tables that nothing reads any more, to give their disk back."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            # rows of the JVM: a list of Python rows starts a second set of Python workers beside that of the Arrow stages, and it stays
            table.sparkSession.range(0).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in table.schema]).write.mode("overwrite").parquet(folder)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is proven small (counted), else ``df`` for a shuffle join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets; nulls count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on and its next task may be another one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library of other systems has no such call
        ctypes.CDLL(None).malloc_trim(0)


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES, kind: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``size`` bytes of text (one text at least).

    Work of one kind begins by dropping what its Python worker HELD for other kinds.
    """
    for other in HELD.keys() - {kind}:
        HELD[other].clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_buffer(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offs, offs[begin] + size, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def small_batches(spark: SparkSession) -> None:
    """From now on the session cuts Arrow batches at BATCH_BYTES, not only at a number of rows, unless it has a limit of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def over_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", size: int = STEP_BYTES, kind: str = "") -> DataFrame:
    """``mapInArrow`` of ``f`` over steps() of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, text, size, kind):
            yield f(step)

    return df.mapInArrow(run, schema)


class Counters:
    """Running numbers 0, 1, 2, ... of each key within a task."""

    def __init__(self) -> None:
        self.seen: dict[int, int] = {}

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The next number of each row's key; keys are small non-negative integers."""
        out = np.empty(len(keys), np.int64)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        cut = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, np.int64)
        for begin, end in zip(cut, np.r_[cut[1:], len(keys)]):
            key = int(ordered[begin])
            at = self.seen.get(key, 0)
            out[order[begin:end]] = np.arange(at, at + end - begin)
            self.seen[key] = at + int(end - begin)
        return out


def with_ranks(numbered: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Gapless global rank within ``key`` from a stored table with task_id and task_row.

    ``task_row`` numbers the rows of a key inside a task (see Counters). The offsets of the
    tasks come from a count per key and task, so no sort and no task that holds a whole key;
    while they are few, the rows themselves aren't moved.
    """
    from pyspark.sql import Window

    counts = stored(numbered.groupBy(key, "task_id").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy(key).orderBy("task_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "task_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    met = numbered.join(small(offsets, counts.count()), [key, "task_id"])
    return met.withColumn(rank, F.col("before") + F.col("task_row")).drop("before")
