"""Two-sided visits: stops choose their delivery, deliveries choose their stop, neighbours lend, overrides decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import haversine
from waymark.operators.joins import range_join
from waymark.sources.store import kept

NEAR_M, WIDE_M = 500.0, 800.0


def own_visits(plan: DataFrame, stops: DataFrame, on: list[str], near_m: float = NEAR_M, wide_m: float = WIDE_M) -> DataFrame:
    """delivery, stop_id, arrive, leave, dist, wide: the stop of each delivery among those that chose it.

    A stop outside the base goes to one delivery only: the nearest of equal ``on``, within ``near_m`` before any up
    to ``wide_m`` (ties by delivery). A delivery keeps the longest of its stops, those within ``near_m`` first (ties
    by start, then stop_id). A stop without an end takes no time. Both choices are aggregations with partial results.
    """
    away = stops.where("kind = 'OUTSIDE' or kind = 'STORE'").select(*on, "stop_id", F.col("start").alias("arrive"), F.coalesce("end", "start").alias("leave"), F.col("lat").alias("lat_r"), F.col("lng").alias("lng_r"))
    met = range_join(plan.select(*on, "delivery", "lat", "lng"), away, on, wide_m, haversine)
    chosen = met.groupBy("stop_id", "arrive", "leave").agg(F.min(F.struct((F.col("dist") > near_m).alias("wide"), "dist", "delivery")).alias("c"))
    stay = (F.col("arrive") - F.col("leave")).alias("stay")  # the longest first
    best = chosen.groupBy("c.delivery").agg(F.min(F.struct("c.wide", stay, "arrive", "stop_id", "leave", "c.dist")).alias("b"))
    return best.select("delivery", "b.stop_id", "b.arrive", "b.leave", "b.dist", "b.wide")


def lent_visits(plan: DataFrame, own: DataFrame, on: list[str], wide_m: float = WIDE_M) -> DataFrame:
    """Visits for deliveries without one: that of the nearest delivery of equal ``on`` that has its own (ties by delivery).

    ``dist`` is the way between the two points. What was lent isn't lent again.
    """
    there = plan.where("lat is not null and lng is not null").select(*on, "delivery", "lat", "lng")
    lenders = there.join(own, "delivery").select(*on, F.col("delivery").alias("lender"), F.col("lat").alias("lat_r"), F.col("lng").alias("lng_r"), "stop_id", "arrive", "leave")
    met = range_join(there.join(own, "delivery", "left_anti"), lenders, on, wide_m, haversine)
    best = met.groupBy("delivery").agg(F.min(F.struct("dist", "lender", "stop_id", "arrive", "leave")).alias("b"))
    return best.select("delivery", "b.stop_id", "b.arrive", "b.leave", "b.dist", "b.lender")


def two_sided_visits(plan: DataFrame, stops: DataFrame, on: list[str], told: DataFrame | None = None, near_m: float = NEAR_M, wide_m: float = WIDE_M) -> DataFrame:
    """delivery, stop_id, arrive, leave, dist, via (own, wide, lent, told), one row for each visited delivery.

    ``plan``: delivery (unique), ``on``, lat, lng; ``stops``: stop_id, ``on``, start, end, kind, lat, lng. ``told``: delivery,
    arrive, leave of a better source; a row of it replaces the visit, and one without both instants removes it. A
    delivery without a point has only what is told. Empty tables give none; null ``on`` meets nothing.
    """
    own = kept(own_visits(plan, stops, on, near_m, wide_m), "visits")
    found = own.withColumn("via", F.when(F.col("wide"), "wide").otherwise("own")).drop("wide")
    found = found.unionByName(lent_visits(plan, own, on, wide_m).withColumn("via", F.lit("lent")).drop("lender"))
    if told is None:
        return found
    said = told.select("delivery", "arrive", "leave").join(plan.select("delivery"), "delivery", "left_semi")
    sure = said.where("arrive is not null and leave is not null")
    sure = sure.select("delivery", F.lit(None).cast(dict(stops.dtypes)["stop_id"]).alias("stop_id"), "arrive", "leave", F.lit(0.0).alias("dist"), F.lit("told").alias("via"))
    return found.join(said.select("delivery"), "delivery", "left_anti").unionByName(sure)
