"""Touched days: the stream equals the batch query after late rows, replays, crashes and restarts."""

import pytest
from pyspark.sql import functions as F

from tests.compare import difference
from waymark.plans import catalog, live
from waymark.streaming.touched import current, recomputed_days

FOLDER = "/root/testdata/sf0.01"


def _events(spark):
    e = spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    return e.withColumn("day", F.floor(F.col("t") / 86_400))


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_sql_on_more_rows(spark):
    assert difference(catalog.queries()["stream_recomputed_days"](spark, FOLDER), catalog.oracle_sql()["stream_recomputed_days"], FOLDER) == ""


def test_replay_crash_and_restart(spark, tmp_path):
    events, come, root = _events(spark).where("t is not null"), str(tmp_path / "come"), f"file://{tmp_path}/root"
    days = sorted(r.day for r in events.select("day").distinct().collect())
    arrive = lambda k, df: df.coalesce(1).write.parquet(f"{come}/{k}")
    stream = lambda: spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(come)
    first, second = events.where(f"day <= {days[1]} and event_id % 10 <> 0"), events.where(f"day = {days[0]} and event_id % 10 = 0")
    arrive(0, first)
    assert _rows(recomputed_days(stream(), live.day_reports, root)) == _rows(live.day_reports(first))

    calls = []

    def crashing(rows):
        calls.append(1)
        if len(calls) > 1:  # the first call only asks for the columns
            raise RuntimeError("lost")
        return live.day_reports(rows)

    arrive(1, second)
    with pytest.raises(Exception, match="lost"):
        recomputed_days(stream(), crashing, root)
    # what the lost batch landed doesn't show, and its replay counts it once
    assert _rows(current(spark, root, live.day_reports(events).schema)) == _rows(live.day_reports(first))
    seen = []

    def watching(rows):
        seen.append({r.day for r in rows.select("day").distinct().collect()})
        return live.day_reports(rows)

    got = recomputed_days(stream(), watching, root)
    assert _rows(got) == _rows(live.day_reports(first.unionByName(second))) and seen[1:] == [{days[0]}]  # no other day is read
    # a batch without a day, and a day whose result becomes empty
    arrive(2, events.limit(3).withColumn("day", F.lit(None).cast("long")))
    assert _rows(recomputed_days(stream(), live.day_reports, root)) == _rows(got)
    arrive(3, second.limit(1))
    left = recomputed_days(stream(), lambda rows: live.day_reports(rows).where("false"), root)
    assert _rows(left) == [r for r in _rows(got) if r[0] != days[0]]


def test_several_batches_of_one_run(spark, tmp_path):
    events, come = _events(spark).where("t is not null"), str(tmp_path / "come")
    for k in range(4):
        events.where(f"event_id % 4 = {k}").coalesce(1).write.parquet(f"{come}/{k}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(come)
    assert _rows(recomputed_days(stream, live.day_reports)) == _rows(live.day_reports(events)) and stream.schema == events.schema


def test_no_rows(spark, tmp_path):
    come = str(tmp_path / "come")
    _events(spark).limit(0).write.parquet(come)
    stream = spark.readStream.schema(_events(spark).schema).parquet(come)
    assert recomputed_days(stream, live.day_reports).count() == 0
