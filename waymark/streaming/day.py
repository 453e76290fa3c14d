"""Incremental day on Structured Streaming: windows with late data, sessions, merges, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.sources.store import shared_path


def file_stream(spark: SparkSession, folder: str, glob: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)


def timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """``event_time`` (a watermark needs an instant; NTZ wall clock is read as the session's zone)."""
    return stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there; the result table. ``complete`` keeps the last batch's rows only."""
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own folder: the sink is idempotent
        target = out if mode == "complete" else f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(out) if mode == "complete" else spark.read.parquet(out).drop("batch")
    return got


def windowed_counts(stream: DataFrame, keys: list[str], width: str) -> DataFrame:
    """Rows per key and tumbling window of event time."""
    return stream.groupBy(F.window("event_time", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(stream: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Sessions of event time: start, end of the last event's gap, n."""
    return stream.groupBy(F.session_window("event_time", gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_arrivals(stream: DataFrame, keys: list[str], t: str) -> DataFrame:
    """The first instant of each key; later ones change nothing."""
    return stream.groupBy(*keys).agg(F.min(t).alias("first"))


def merged_batches(stream: DataFrame, name: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """Fold each micro-batch into a snapshot table: snapshot k + 1 = merge(snapshot k, batch k).

    Every batch writes a new snapshot of its own number and reads the one before, so a repeated
    batch gives the same table; older snapshots are emptied. ``root`` names the folder of state
    and snapshots: a driver that starts again with it goes on where the last one ended. Without
    any batch the result is what an empty batch gives.
    """
    spark = stream.sparkSession
    root = root or shared_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.parquet(f"{root}/{number - 1}") if number else None
        merge(before, batch).write.mode("overwrite").parquet(f"{root}/{number}")
        session.range(number, number + 1).write.mode("overwrite").parquet(f"{root}/last")
        if number > 1:
            old = session.read.parquet(f"{root}/{number - 2}")
            session.createDataFrame([], old.schema).write.mode("overwrite").parquet(f"{root}/{number - 2}")

    stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    try:
        last = spark.read.schema("id long").parquet(f"{root}/last").first().id
    except AnalysisException:  # there was never a batch
        return merge(None, spark.createDataFrame([], stream.schema))
    return spark.read.parquet(f"{root}/{last}")


def outage_alerts(stream: DataFrame, key: str, t: str, failing: str, minutes: int = 60, first_hour: int = 5, last_hour: int = 20) -> DataFrame:
    """One alert per outage of a source: failing for ``minutes`` at an hour that counts; a success ends the outage.

    ``t`` are wall-clock seconds; the state of a source is when it began to fail and whether it has alerted.
    Columns: key, since, alerted_at.
    """

    def run(source: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, alerted = state.get if state.exists else (None, False)
        rows = pd.concat(list(parts)).sort_values(t, kind="stable")
        found = []
        for now, bad in zip(rows[t].tolist(), rows[failing].tolist()):
            if not bad:
                since, alerted = None, False
                continue
            since = now if since is None else since
            if not alerted and now - since >= 60 * minutes and first_hour <= now % 86_400 // 3600 <= last_hour:
                alerted = True
                found.append((since, now))
        state.update((since, alerted))
        yield pd.DataFrame({key: [source[0]] * len(found), "since": [a for a, _ in found], "alerted_at": [b for _, b in found]})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, t, failing).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, since long, alerted_at long", "since long, alerted boolean", "append", GroupStateTimeout.NoTimeout)


def confirmed_shrink(stream: DataFrame, key: str, t: str, size: str) -> DataFrame:
    """Accepted sizes: a smaller one counts only when the next tick says the same. Columns: key, t, accepted."""

    def run(source: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, asked = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values(t, kind="stable")
        out = []
        for n in rows[size].tolist():
            if held is None or n >= held or n == asked:
                held, asked = n, None
            else:
                asked = n
            out.append(held)
        state.update((held, asked))
        yield pd.DataFrame({key: [source[0]] * len(out), t: rows[t].tolist(), "accepted": out})

    kind = dict(stream.dtypes)
    return stream.select(key, t, size).groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, {t} {kind[t]}, accepted long", "held long, asked long", "append", GroupStateTimeout.NoTimeout)


def must_close(computed: Column, day: Column, now: Column, minutes: int = 30) -> Column:
    """Whether a day (number) must be computed a last time: ``minutes`` past its midnight, and not yet computed since."""
    final = (day + 1) * 86_400 + 60 * minutes
    return (now >= final) & (computed.isNull() | (computed < final))


def in_progress(stops: DataFrame, keys: list[str], now: Column, minutes: int = 5) -> DataFrame:
    """The last stop of each key that isn't at base, if it ended ``minutes`` ago at most."""
    from waymark.operators.joins import best_per

    last = best_per(stops, keys, [F.col("start").desc(), F.col("stop_id").desc()])
    return last.where((F.col("kind") != "BASE") & (now - F.col("end") <= 60 * minutes))


def decayed(df: DataFrame, confidence: str, seen_day: str, today: Column, per_day: float = 0.01, floor: float = 0.1) -> DataFrame:
    """Confidence less ``per_day`` for each day since it was last seen, not below the floor."""
    return df.withColumn(confidence, F.greatest(F.lit(floor), F.col(confidence) - per_day * (today - F.col(seen_day))))


def learned(evidence: DataFrame, key: list[str]) -> DataFrame:
    """The value to trust for each key: manual, then confirmed twice, then orphan twice, then a single one.

    ``evidence``: kind (manual, confirmed, orphan), value, day.
    """
    from waymark.operators.joins import best_per

    got = evidence.groupBy(*key, "kind", "value").agg(F.countDistinct("day").alias("days"), F.max("day").alias("last"))
    rank = F.when(F.col("kind") == "manual", 1).when((F.col("kind") == "confirmed") & (F.col("days") >= 2), 2).when((F.col("kind") == "orphan") & (F.col("days") >= 2), 3).otherwise(4)
    return best_per(got.withColumn("rank", rank), key, [F.col("rank"), F.col("days").desc(), F.col("last").desc(), F.col("value")])
