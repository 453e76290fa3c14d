"""Queries of the incremental day: streams over the events file, state, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.time import wall_seconds
from waymark.plans import inputs as i
from waymark.plans.catalog import query
from waymark.sources import sinks
from waymark.sources.store import shared_path, table
from waymark.streaming import day
from waymark.streaming.touched import recomputed_days


def _events(spark: SparkSession, d: str) -> DataFrame:
    return day.file_stream(spark, d, "events.parquet*", table(spark, d, "events").schema)


@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    got = day.drained(day.windowed_counts(day.timed(_events(spark, d), "ts", "1 day"), ["event_type"], "1 hour"), "complete", "windows")
    return got.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM s GROUP BY user_id, k")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    got = day.drained(day.sessions(day.timed(_events(spark, d), "ts", "1 day"), ["user_id"], "6 hours"), "complete", "sessions")
    return got.select("user_id", "n", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("first"))


@query("SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first FROM events GROUP BY user_id")
def stream_first_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return day.drained(day.first_arrivals(_events(spark, d).withColumn("t", wall_seconds(F.col("ts"))), ["user_id"], "t"), "complete", "arrivals")


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def stream_merged_snapshot(spark: SparkSession, d: str) -> DataFrame:
    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.select("user_id", F.lit(1).cast("long").alias("n"), F.col("event_id").alias("last"))
        both = new if before is None else before.unionByName(new)
        return both.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    return day.merged_batches(_events(spark, d), "snapshot", merge)


@query()
def stream_outage_alerts(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).select("user_id", wall_seconds(F.col("ts")).alias("t"), F.col("event_type").isin("error", "view").alias("failing"))
    return day.drained(day.outage_alerts(s, "user_id", "t", "failing"), "append", "alerts")


@query()
def stream_confirmed_shrink(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).select("user_id", wall_seconds(F.col("ts")).alias("t"), F.floor("value").alias("size"))
    return day.drained(day.confirmed_shrink(s, "user_id", "t", "size"), "append", "shrink")


@query(f"WITH {i.STOPS}, l AS (SELECT * FROM stops QUALIFY row_number() OVER (PARTITION BY vehicle ORDER BY start DESC, stop_id DESC) = 1) SELECT vehicle, stop_id FROM l WHERE kind <> 'BASE' AND {i.T0 + 130000} - \"end\" <= 300")
def stops_in_progress(spark: SparkSession, d: str) -> DataFrame:
    return day.in_progress(i.stops(spark, d), ["vehicle"], F.lit(i.T0 + 130000)).select("vehicle", "stop_id")


@query(f"WITH {i.STOPS} SELECT stop_id FROM stops WHERE {i.T0 + 90000} >= (start // 86400 + 1) * 86400 + 1800 AND \"end\" < (start // 86400 + 1) * 86400 + 1800")
def days_to_close(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d)
    return s.where(day.must_close(F.col("end"), F.floor(F.col("start") / 86400), F.lit(i.T0 + 90000))).select("stop_id")


@query("SELECT p_partkey AS id, greatest(0.1e0, p_size / 50e0 - 0.01e0 * (p_partkey % 60)) AS confidence FROM part")
def decayed_confidence(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("confidence"), (100 - F.col("p_partkey") % 60).alias("seen"))
    return day.decayed(p, "confidence", "seen", F.lit(100)).select("id", "confidence")


_EV = f"WITH {i.STOPS}, e AS (SELECT vehicle AS client, CASE WHEN kind = 'BASE' THEN 'manual' WHEN kind = 'STORE' THEN 'confirmed' ELSE 'orphan' END AS kind, stop_id % 5 AS value, start // 7200 AS day FROM stops)"


@query(_EV + ", g AS (SELECT client, kind, value, count(DISTINCT day) AS days, max(day) AS last FROM e GROUP BY ALL) SELECT client, kind, value, days FROM g QUALIFY row_number() OVER (PARTITION BY client ORDER BY CASE WHEN kind = 'manual' THEN 1 WHEN kind = 'confirmed' AND days >= 2 THEN 2 WHEN kind = 'orphan' AND days >= 2 THEN 3 ELSE 4 END, days DESC, last DESC, value) = 1")
def learned_values(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "BASE", "manual").when(F.col("kind") == "STORE", "confirmed").otherwise("orphan")
    e = i.stops(spark, d).select(F.col("vehicle").alias("client"), kind.alias("kind"), (F.col("stop_id") % 5).alias("value"), F.floor(F.col("start") / 7200).alias("day"))
    return day.learned(e, ["client"]).select("client", "kind", "value", "days")


@query(f"WITH {i.ENTRIES} SELECT year(day) AS year, entry, CASE WHEN year(day) = 1997 THEN 'new' ELSE 'old' END AS version FROM entries WHERE year(day) <> 1997 OR entry % 2 = 0")
def replaced_partitions(spark: SparkSession, d: str) -> DataFrame:
    e = i.entries(spark, d).select(F.year("day").cast("long").alias("year"), "entry", F.lit("old").alias("version"))
    path = shared_path(spark, "partitions")
    sinks.replace_partitions(e, path, ["year"])
    sinks.replace_partitions(e.where("year = 1997 and entry % 2 = 0").withColumn("version", F.lit("new")), path, ["year"])
    return spark.read.parquet(path).select(F.col("year").cast("long").alias("year"), "entry", "version")


@query(f"WITH {i.ENTRIES}, n AS (SELECT year(day) AS year, count(*) AS n FROM entries GROUP BY 1) SELECT year, CASE WHEN year % 2 = 0 THEN n + 5 ELSE n END AS n FROM n")
def saved_if_larger(spark: SparkSession, d: str) -> DataFrame:
    n = i.entries(spark, d).groupBy(F.year("day").cast("long").alias("year")).agg(F.count("*").alias("n"))
    path = shared_path(spark, "summaries")
    sinks.save_if_larger(n, path, ["year"], "n")
    sinks.save_if_larger(n.withColumn("n", F.when(F.col("year") % 2 == 0, F.col("n") + 5).otherwise(F.col("n") - 5)), path, ["year"], "n")
    return spark.read.parquet(path).select(F.col("year").cast("long").alias("year"), "n")


@query()
def grown_snapshot(spark: SparkSession, d: str) -> DataFrame:
    from waymark.operators.kernels import united_intervals

    s = i.stops(spark, d).withColumn("day", F.floor(F.col("start") / 86400)).select("vehicle", "day", "start", "end", "lat", "lng")
    path = shared_path(spark, "retained")
    for part in (s.where("start % 2 = 0"), s.where("start % 2 = 1")):
        sinks.grow_only(part, path, ["day"], lambda df: united_intervals(df, ["vehicle", "day"], "start", "end", 500.0))
    return spark.read.schema(s.schema).parquet(path)


def day_reports(events: DataFrame) -> DataFrame:
    """day, users, n, longest_gap: figures of whole days that can't be added up batch by batch (gaps within a user's day)."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("day", "user_id").orderBy("t", "event_id"))
    users = events.withColumn("gap", gap).groupBy("day", "user_id").agg(F.count("*").alias("n"), F.max("gap").alias("gap"))
    return users.groupBy("day").agg(F.count("*").alias("users"), F.sum("n").alias("n"), F.max("gap").alias("longest_gap"))


@query("WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), g AS (SELECT t // 86400 AS day, user_id, t - lag(t) OVER (PARTITION BY t // 86400, user_id ORDER BY t, event_id) AS gap FROM e) SELECT day, count(DISTINCT user_id) AS users, count(*) AS n, max(gap) AS longest_gap FROM g GROUP BY day")
def stream_recomputed_days(spark: SparkSession, d: str) -> DataFrame:
    """Events arrive in four parts, each with rows of all days; every part computes its days anew."""
    e = table(spark, d, "events").select("event_id", "user_id", wall_seconds(F.col("ts")).alias("t")).withColumn("day", F.floor(F.col("t") / 86_400))
    parts = shared_path(spark, "arriving")
    for k in range(4):
        e.where(F.pmod(F.hash("event_id"), F.lit(4)) == k).write.parquet(f"{parts}/{k}")
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 4).parquet(parts)
    return recomputed_days(stream, day_reports)
