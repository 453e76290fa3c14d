"""Many rows at few places: results are right, and no job pairs them all."""

import threading
import time
from contextlib import contextmanager

import numpy as np
from pyspark.sql import functions as F

from waymark.functions.geo import haversine
from waymark.operators import cascade, evidence, joins, kernels, review, verdicts

AT = (-22.9, -43.2)


@contextmanager
def within(spark, seconds):
    """Jobs that still run after so many seconds are cancelled, which fails the test."""
    late = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        yield
    finally:
        late.cancel()


def _at(df, metres, suffix=""):
    """``df`` with a point that many metres north."""
    return df.withColumn(f"lat{suffix}", F.lit(AT[0]) + metres / 111_195).withColumn(f"lng{suffix}", F.lit(AT[1]))


def _covered(spark, group, visitor):
    """60,000 points at two places and 60,000 stops at a third: all within 500 m of the first place, 2 visitors near the second as well."""
    k = F.col("id")
    points = _at(spark.range(60_000).withColumn("metres", F.when(k % 4 == 0, 700).otherwise(0)), F.col("metres")).select((k % 2).alias("day"), F.lit(7).alias(group), k.alias("point_id"), "lat", "lng")
    stops = _at(spark.range(60_000).withColumn("metres", F.when(k < 4, 400).otherwise(-100)), F.col("metres"), "_r").select((k % 2).alias("day"), (F.floor(k / 2) % 3000).alias(visitor), "lat_r", "lng_r")
    return joins.coverage(points, stops, group, visitor, 500.0, haversine, 40, 2, ["day"])


def test_coverage_of_dense_places(spark):
    with within(spark, 60):
        got = _covered(spark, "load", "mate").collect()
    assert len(got) == 6000 and {r.total for r in got} == {30_000}
    # points with a number divisible by 4 lie on day 0
    assert {(r.day, r.mate) for r in got if r.covered == r.total} == {(0, 0), (0, 1)} | {(1, m) for m in range(3000)} and {r.covered for r in got} == {15_000, 30_000}


def test_only_leader_of_dense_places(spark):
    with within(spark, 60):
        got = joins.only_leader(_covered(spark, "load", "mate").where("day = 0 and mate > 0"), ["day", "load"], "covered").collect()
    assert [(r.day, r.load, r.mate, r.covered) for r in got] == [(0, 7, 1, 30_000)]


def test_rotation_of_a_dense_load(spark):
    """Vehicles 1 and 2 pass all of a load of 40,000 rows, of which 10 are vehicle 2's own and 1 has none; vehicle 3 passes none of it."""
    k = F.col("id")
    vehicle = F.when(k == 11, None).when(k <= 10, 2).otherwise(9)
    rows = _at(spark.range(1, 40_001), F.lit(0)).select(
        k.alias("delivery"), vehicle.alias("vehicle"), F.lit(5).alias("load"), "lat", "lng", F.lit(100).alias("planned_at"), F.lit("none").alias("kind"), F.lit("pending").alias("status"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("dist"), F.lit(None).cast("string").alias("note")
    )
    stops = _at(spark.range(60_000), F.when(k % 3 == 2, 5000).otherwise(50 + k % 3), "_r").select(k.alias("stop_id"), (k % 3 + 1).alias("by"), (k % 86_400).alias("start"), (k % 86_400 + 300).alias("end"), "lat_r", "lng_r")
    with within(spark, 60):
        got = cascade.rotated_load(rows, stops).groupBy("kind", "note", "at", F.round("dist").alias("dist")).agg(F.count("*").alias("n")).collect()
    assert sorted(((r.kind, r.note, r.at, r.dist, r.n) for r in got), key=str) == [("none", "plan plate did not pass", None, None, 1), ("rotation", "rotation", 0, 50.0, 39_999)]


def test_suggestions_at_one_place(spark):
    """40,000 stops of two names, one of them null, and 3000 stores, all at one place: the best of each name are looked for once."""
    k = F.col("id")
    stops = _at(spark.range(40_000), F.lit(0)).select(k.alias("stop_id"), F.when(k % 2 == 0, "Store 12").alias("nm"), "lat", "lng")
    stores = _at(spark.range(3000), F.when(k < 10, 10).otherwise(20), "_r").select(k.alias("store_id"), F.concat(F.lit("STORE "), F.lpad(k.cast("string"), 4, "0")).alias("nr"), "lat_r", "lng_r")
    with within(spark, 60):
        got = review.suggestions(stops, stores, ["stop_id"], "nm", "nr", 800.0, 2).groupBy("nm", "place", "store_id").agg(F.count("*").alias("n")).collect()
    assert {(r.nm, r.place, r.store_id): r.n for r in got} == {(None, 1, 0): 20_000, (None, 2, 1): 20_000, ("Store 12", 1, 0): 20_000, ("Store 12", 2, 1): 20_000}


def test_other_vehicles_at_dense_places(spark):
    """20,000 rows of three vehicles beside 40,000 stops: vehicle 1 made the nearest ones, vehicle 2 the first at the second place, vehicle 3 stops no two minutes."""
    k = F.col("id")
    plan = _at(spark.range(20_000), F.lit(0)).select(k.alias("delivery"), (k % 3 + 1).alias("vehicle"), "lat", "lng", F.lit(100).alias("planned_at"))
    who = F.when(k < 20_000, 1).when(k % 2 == 0, 2).otherwise(3)
    stops = _at(spark.range(40_000), F.when(who == 1, 50).otherwise(90), "_r").select(k.alias("stop_id"), who.alias("vehicle"), (k % 80_000).alias("start"), (k % 80_000 + F.when(who == 3, 60).otherwise(300)).alias("end"), "lat_r", "lng_r")
    with within(spark, 60):
        got = evidence.other_vehicle_stop(plan, stops).join(plan, "delivery").groupBy("vehicle", "by", "stop_id", "start").agg(F.count("*").alias("n")).collect()
    assert {(r.vehicle, r.by, r.stop_id, r.start): r.n for r in got} == {(1, 2, 20_000, 20_000): 6667, (2, 1, 0, 0): 6667, (3, 1, 0, 0): 6666}


def _decided(spark):
    """20,000 rows of a vehicle without stops, every tenth out of reach, beside 40,000 stops of another."""
    k = F.col("id")
    plan = _at(spark.range(20_000), F.when(k % 10 == 0, 9000).otherwise(0)).select(k.alias("delivery"), F.lit(4).alias("vehicle"), F.floor(k / 20).alias("client"), "lat", "lng", (100 + k % 20).alias("planned_at"))
    stops = _at(spark.range(40_000), F.lit(50), "_r").select(k.alias("stop_id"), F.lit(1).alias("vehicle"), (k % 80_000).alias("start"), (k % 80_000 + 300).alias("end"), "lat_r", "lng_r")
    return evidence.decided(plan, stops, plan.limit(0).select("delivery", F.col("planned_at").alias("at")))


def test_evidence_at_dense_places(spark):
    with within(spark, 60):
        got = _decided(spark).groupBy("kind", "status", "at").agg(F.count("*").alias("n")).collect()
    assert {(r.kind, r.status, r.at): r.n for r in got} == {("other_vehicle", "confirmed", 0): 18_000, ("none", "pending", None): 2000}


def test_same_address_at_dense_places(spark):
    with within(spark, 60):
        got = evidence.taken_up(_decided(spark), ["client"]).groupBy("kind", "status", "at").agg(F.count("*").alias("n")).collect()
    assert {(r.kind, r.status, r.at): r.n for r in got} == {("other_vehicle", "confirmed", 0): 18_000, ("same_address", "confirmed", 0): 2000}


def test_long_trips():
    """A trip of 2500 stops out of order gets its short path within 20 CPU seconds; the loops in Python took 29."""
    some = np.random.default_rng(7)
    lat, lng = -22.9 + some.random(2500) / 20, -43.2 + some.random(2500) / 20
    began = time.process_time()
    short = kernels.best_path(lat, lng)
    assert time.process_time() - began < 20
    # a tour through n random points of an area is about 0.7124 sqrt(n * area) long; this kind of search stays within some 10 % of that
    area = kernels.metres(-22.9, -43.2, -22.85, -43.2) * kernels.metres(-22.875, -43.2, -22.875, -43.15)
    assert 0.65 * (2500 * area) ** 0.5 < short < 0.85 * (2500 * area) ** 0.5


def test_first_visits_pair_without_sorts(spark):
    """The first visits of two vehicles at three stores of two places; pairs are neither sorted nor exchanged."""
    k = F.col("id")
    stops = _at(spark.range(20_000), F.when(k % 4 < 2, 0).otherwise(1000)).select(k.alias("stop_id"), (k % 2).alias("vehicle"), F.when(k < 8, "BASE").otherwise("STORE").alias("kind"), (50_000 - F.floor(k / 8)).alias("start"), "lat", "lng")
    stores = _at(spark.range(3), F.when(k == 2, 900).otherwise(100), "_r").select(k.alias("store_id"), "lat_r", "lng_r")
    found = verdicts.first_outside_visit(stops, stores, 600.0, haversine)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("hashpartitioning(vehicle") == 1, plan
    assert {tuple(r) for r in found.collect()} == {(v, s, 19_992 + v + 2 * (s == 2), 47_501) for v in (0, 1) for s in (0, 1, 2)}
