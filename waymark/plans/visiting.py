"""Queries of two-sided visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.time import DAY
from waymark.operators.visits import lent_visits, own_visits, two_sided_visits
from waymark.plans import inputs as i
from waymark.plans.catalog import query
from waymark.sources.store import kept

_ON = ["vehicle", "day"]


def _plan(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries with their day, both of a client on one vehicle; every 23rd without a point."""
    p = i.deliveries(spark, d).withColumn("vehicle", F.col("client") % 150).withColumn("day", F.floor(F.col("planned_at") / DAY))
    return p.withColumn("lat", F.when(F.col("delivery") % 23 != 0, F.col("lat")))


def _stops(spark: SparkSession, d: str) -> DataFrame:
    """Stops with their day; every 17th still without an end."""
    s = i.stops(spark, d).withColumn("day", F.floor(F.col("start") / DAY))
    return s.withColumn("end", F.when(F.col("stop_id") % 17 != 0, F.col("end")))


def _told(plan: DataFrame) -> DataFrame:
    at = F.when(F.col("delivery") % 14 != 0, F.col("planned_at"))
    return plan.where("delivery % 7 = 0").select("delivery", at.alias("arrive"), (at + 900).alias("leave"))


_SQL = f"""WITH {i.STOPS}, {i.DELIVERIES},
plan AS (SELECT delivery, client % 150 AS vehicle, planned_at, planned_at // 86400 AS day, CASE WHEN delivery % 23 <> 0 THEN lat END AS lat, lng FROM deliveries),
away AS (SELECT stop_id, vehicle, start // 86400 AS day, start AS arrive, CASE WHEN stop_id % 17 <> 0 THEN "end" ELSE start END AS leave, lat, lng FROM stops WHERE kind IN ('OUTSIDE', 'STORE')),
met AS (SELECT p.delivery, a.stop_id, a.arrive, a.leave, {i.haversine_sql("p.lat", "p.lng", "a.lat", "a.lng")} AS dist FROM plan p JOIN away a USING (vehicle, day)),
chosen AS (SELECT *, dist > 500 AS wide FROM met WHERE dist <= 800 QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY dist > 500, dist, delivery) = 1),
own AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY wide, arrive - leave, arrive, stop_id) = 1),
lender AS (SELECT o.*, p.vehicle, p.day, p.lat, p.lng FROM own o JOIN plan p USING (delivery)),
lent AS (SELECT p.delivery, l.stop_id, l.arrive, l.leave, {i.haversine_sql("p.lat", "p.lng", "l.lat", "l.lng")} AS dist, l.delivery AS lender
  FROM plan p JOIN lender l USING (vehicle, day) WHERE p.delivery NOT IN (SELECT delivery FROM own) AND {i.haversine_sql("p.lat", "p.lng", "l.lat", "l.lng")} <= 800
  QUALIFY row_number() OVER (PARTITION BY p.delivery ORDER BY {i.haversine_sql("p.lat", "p.lng", "l.lat", "l.lng")}, l.delivery) = 1),
told AS (SELECT delivery, CASE WHEN delivery % 14 <> 0 THEN planned_at END AS arrive FROM plan WHERE delivery % 7 = 0),
found AS (SELECT delivery, stop_id, arrive, leave, dist, CASE WHEN wide THEN 'wide' ELSE 'own' END AS via FROM own UNION ALL SELECT delivery, stop_id, arrive, leave, dist, 'lent' FROM lent) """


@query(_SQL + "SELECT * FROM found WHERE delivery NOT IN (SELECT delivery FROM told) UNION ALL SELECT delivery, NULL, arrive, arrive + 900, 0e0, 'told' FROM told WHERE arrive IS NOT NULL")
def visits_of_both_sides(spark: SparkSession, d: str) -> DataFrame:
    plan = _plan(spark, d)
    return two_sided_visits(plan, _stops(spark, d), _ON, _told(plan))


@query(_SQL + "SELECT delivery, lender, stop_id, dist FROM lent")
def lent_neighbour_visits(spark: SparkSession, d: str) -> DataFrame:
    plan = _plan(spark, d)
    own = kept(own_visits(plan, _stops(spark, d), _ON), "visits")
    return lent_visits(plan, own, _ON).select("delivery", "lender", "stop_id", "dist")
