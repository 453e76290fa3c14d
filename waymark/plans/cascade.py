"""Queries of the later layers of the evidence cascade, each over all deliveries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import cascade, evidence
from waymark.plans import catalog
from waymark.plans import inputs as i



def query(sql: str):
    """Register with the columns ``at`` and ``by`` quoted, which are keywords in SQL."""
    return catalog.query(re.sub(r"(?<![\w.\"])(at|by)(?![\w\"])", r'"\1"', sql))


_KIND = "CASE delivery % 6 WHEN 0 THEN 'own_ring' WHEN 1 THEN 'target_done' WHEN 2 THEN 'wide_ring' WHEN 3 THEN 'near' WHEN 4 THEN 'other_vehicle' ELSE 'none' END"
_STATUS = "CASE WHEN delivery % 6 IN (0, 1, 4) THEN 'confirmed' WHEN delivery % 6 = 2 THEN 'review' ELSE 'pending' END"
_H = i.haversine_sql("lat", "lng", "lat_r", "lng_r")
_ROWS = f"""WITH {i.STOPS}, {i.DELIVERIES}, base AS (SELECT delivery, client, CASE WHEN delivery % 31 <> 0 THEN vehicle END AS vehicle, delivery % 97 AS load, lat, lng, planned_at, {_KIND} AS kind, {_STATUS} AS status,
  CASE WHEN delivery % 6 IN (0, 1, 4) THEN planned_at END AS at, CASE WHEN delivery % 6 <> 1 THEN CAST(delivery % 900 AS DOUBLE) END AS dist, CAST(NULL AS VARCHAR) AS note FROM deliveries),
 s AS (SELECT stop_id, vehicle AS v, start, "end" AS e, lat AS lat_r, lng AS lng_r FROM stops),
 pairs AS (SELECT delivery, client, stop_id, start, e, d AS dist FROM (SELECT *, {_H} AS d FROM deliveries JOIN s ON vehicle = v) WHERE d <= 2000)"""


def _out(kind: str = "kind", status: str = "status", at: str = "at", dist: str = "dist", note: str = "note") -> str:
    return f"delivery, {kind} AS kind, {status} AS status, {at} AS at, {i.hundredths_sql(dist)} AS dist, {note} AS note"


def _taken(kind: str, note: str | None, hit: str = "b.start IS NOT NULL AND r.status = 'pending'") -> str:
    say = lambda new, old: f"CASE WHEN {hit} THEN {new} ELSE r.{old} END"
    return "SELECT r." + _out(say(f"'{kind}'", "kind"), say("'confirmed'", "status"), say("b.start", "at"), say("b.dist", "dist"), say(f"'{note}'", "note") if note else "r.note") + " FROM base r LEFT JOIN best b USING (delivery)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    v = i.deliveries(spark, d)
    sure = F.expr("delivery % 6 IN (0, 1, 4)")
    return v.select(
        "delivery", "client", F.when(F.col("delivery") % 31 != 0, F.col("vehicle")).alias("vehicle"), (F.col("delivery") % 97).alias("load"), "lat", "lng", "planned_at", F.expr(_KIND).alias("kind"), F.expr(_STATUS).alias("status"),
        F.when(sure, F.col("planned_at")).alias("at"), F.when(F.col("delivery") % 6 != 1, (F.col("delivery") % 900).cast("double")).alias("dist"), F.lit(None).cast("string").alias("note"),
    )


def _stops(spark: SparkSession, d: str) -> DataFrame:
    return i.stops(spark, d).select("stop_id", "vehicle", "start", "end", F.col("lat").alias("lat_r"), F.col("lng").alias("lng_r"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return evidence.own_pairs(i.deliveries(spark, d), _stops(spark, d))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("delivery", "kind", "status", "at", i.hundredths(F.col("dist")).alias("dist"), "note")


@query(_ROWS + " SELECT " + _out(*[f"CASE WHEN vehicle IS NULL THEN {new} ELSE {c} END" for c, new in (("kind", "'none'"), ("status", "'pending'"), ("at", "NULL"), ("dist", "NULL"), ("note", "'no vehicle'"))]) + " FROM base")
def layer_without_vehicle(spark: SparkSession, d: str) -> DataFrame:
    return _shown(cascade.without_vehicle(_rows(spark, d)))


@query(_ROWS + f", near AS (SELECT stop_id, min(client) AS lo, max(client) AS hi FROM pairs WHERE dist <= 300 GROUP BY 1), best AS (SELECT delivery, start, dist FROM pairs LEFT JOIN near USING (stop_id) WHERE dist > 500 AND e - start >= 180 AND (lo IS NULL OR (lo = client AND hi = client)) QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY start - e, dist, stop_id) = 1) {_taken('isolated', 'nearby stop')}")
def layer_isolated(spark: SparkSession, d: str) -> DataFrame:
    return _shown(cascade.isolated_own_stop(_rows(spark, d), _pairs(spark, d)))


@query(_ROWS + f", proof AS (SELECT stop_id, min(client) AS lo, max(client) AS hi FROM pairs WHERE dist <= 1500 AND e - start >= 60 GROUP BY 1), best AS (SELECT delivery, start, dist FROM pairs JOIN proof USING (stop_id) WHERE dist <= 1500 AND e - start >= 60 AND (lo <> client OR hi <> client) QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY dist, stop_id) = 1) {_taken('neighbour', 'shared with a neighbour')}")
def layer_neighbour(spark: SparkSession, d: str) -> DataFrame:
    return _shown(cascade.neighbour_shared(_rows(spark, d), _pairs(spark, d), 1500.0, 1500.0, 60))


_PENDING = "base2 AS (SELECT * REPLACE (CASE WHEN load % 3 = 0 THEN 'pending' ELSE status END AS status) FROM base)"


@query(_ROWS + f""", {_PENDING}, total AS (SELECT load, count(*) AS n FROM base2 GROUP BY 1 HAVING bool_and(status = 'pending')), met AS (SELECT delivery, load, v AS by, start, d, stop_id FROM (SELECT *, {_H} AS d FROM base2, s WHERE vehicle <> v AND status = 'pending' AND start // 86400 = planned_at // 86400) WHERE d <= 1500),
 near AS (SELECT load, by, delivery, start, d FROM met QUALIFY row_number() OVER (PARTITION BY load, by, delivery ORDER BY d, stop_id) = 1), cover AS (SELECT load, by, count(*) AS c FROM near JOIN total USING (load) GROUP BY load, by, n HAVING count(*) >= 2 AND 100 * count(*) >= 50 * n),
 top AS (SELECT load, by FROM cover QUALIFY row_number() OVER (PARTITION BY load ORDER BY c DESC, by DESC) = 1), hit AS (SELECT delivery, start, d FROM near JOIN top USING (load, by))
 SELECT delivery, CASE WHEN h.start IS NOT NULL THEN 'rotation' ELSE kind END AS kind, CASE WHEN h.start IS NOT NULL THEN 'confirmed' ELSE status END AS status, coalesce(h.start, at) AS at, {i.hundredths_sql('coalesce(h.d, dist)')} AS dist, CASE WHEN h.start IS NOT NULL THEN 'rotation' WHEN t.by IS NOT NULL THEN 'plan plate did not pass' END AS note
 FROM base2 LEFT JOIN top t USING (load) LEFT JOIN hit h USING (delivery)""")
def layer_rotation(spark: SparkSession, d: str) -> DataFrame:
    rows = cascade.changed(_rows(spark, d), F.col("load") % 3 == 0, status="pending")
    return _shown(cascade.rotated_load(rows, _stops(spark, d).withColumnRenamed("vehicle", "by"), 50, 2, 1500.0))


@query(_ROWS + " SELECT " + _out(note="CASE WHEN vehicle % 4 = 0 AND status = 'pending' THEN 'waiting' ELSE note END") + " FROM base")
def layer_waiting(spark: SparkSession, d: str) -> DataFrame:
    return _shown(cascade.waiting(_rows(spark, d), i.deliveries(spark, d).where("vehicle % 4 = 0").select("vehicle")))


_SIGNED = "kind = 'target_done' AND b.start IS NOT NULL"


@query(_ROWS + f", best AS (SELECT delivery, start, dist FROM pairs JOIN (SELECT delivery, planned_at + 40000 AS signed FROM deliveries WHERE delivery % 6 = 1) USING (delivery) WHERE e <= signed AND e >= signed - 86400 QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY e DESC, stop_id DESC) = 1) SELECT r.delivery, CASE WHEN {_SIGNED} THEN 'before_sign_off' ELSE kind END AS kind, status, CASE WHEN {_SIGNED} THEN b.start ELSE r.at END AS at, {i.hundredths_sql(f'CASE WHEN {_SIGNED} THEN b.dist ELSE r.dist END')} AS dist, note FROM base r LEFT JOIN best b USING (delivery)")
def layer_before_sign_off(spark: SparkSession, d: str) -> DataFrame:
    done = i.deliveries(spark, d).where("delivery % 6 = 1").select("delivery", (F.col("planned_at") + 40000).alias("at"))
    return _shown(cascade.time_before_sign_off(_rows(spark, d), done, _pairs(spark, d), 2000.0, 86400))


_REG = "reg AS (SELECT client, any_value(-22.9e0 + ((client % 300) * 41 % 97) / 1e3 + CASE WHEN client % 9 = 0 THEN 0.02e0 ELSE 0e0 END) AS reg_lat, any_value(-43.2e0 + ((client % 300) * 59 % 89) / 1e3) AS reg_lng FROM deliveries GROUP BY client), same AS (SELECT reg_lat, reg_lng FROM reg GROUP BY ALL HAVING count(DISTINCT client) > 1)"


@query(_ROWS + f""", {_REG}, w AS (SELECT b.*, CASE WHEN {i.haversine_sql('lat', 'lng', 'r.reg_lat', 'r.reg_lng')} > 1000 THEN 'registry far from address' WHEN {i.haversine_sql('lat', 'lng', '-22.85e0', '-43.15e0')} <= 1500 THEN 'client inside base' WHEN kind = 'other_vehicle' AND dist > 400 THEN 'weak and far'
  WHEN m.reg_lat IS NOT NULL AND kind <> 'own_ring' THEN 'repeated registry point' END AS why FROM base b LEFT JOIN reg r USING (client) LEFT JOIN same m ON m.reg_lat = r.reg_lat AND m.reg_lng = r.reg_lng)
 SELECT {_out(status="CASE WHEN status = 'confirmed' AND why IS NOT NULL THEN 'review' ELSE status END", note="CASE WHEN status = 'confirmed' THEN why END")} FROM w""")
def layer_demotions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("client")
    reg = i.deliveries(spark, d).select("client").distinct()
    reg = reg.select("client", (-22.9 + c % 300 * 41 % 97 / 1000 + F.when(c % 9 == 0, 0.02).otherwise(0.0)).alias("reg_lat"), (-43.2 + c % 300 * 59 % 89 / 1000).alias("reg_lng"))
    return _shown(cascade.demoted(_rows(spark, d), reg, (-22.85, -43.15), base_m=1500.0))


_TIMED = ", first AS (SELECT delivery, start, dist FROM pairs QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY start, stop_id) = 1), rows AS (SELECT b.* REPLACE (CASE WHEN status = 'confirmed' THEN f.start END AS at, CASE WHEN status = 'confirmed' THEN f.dist END AS dist) FROM base b LEFT JOIN first f USING (delivery)), used AS (SELECT r.delivery, r.client, r.at, r.dist, p.stop_id, p.e FROM rows r JOIN pairs p ON p.delivery = r.delivery AND p.start = r.at WHERE status = 'confirmed')"


def _timed(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    first = pairs.groupBy("delivery").agg(F.min(F.struct("start", "stop_id", "dist")).alias("f"))
    rows = _rows(spark, d).join(first, "delivery", "left")
    sure = F.col("status") == "confirmed"
    return rows.withColumn("at", F.when(sure, F.col("f.start"))).withColumn("dist", F.when(sure, F.col("f.dist"))).drop("f")


@query(_ROWS + _TIMED + f""", lost AS (SELECT DISTINCT delivery FROM used WHERE stop_id IN (SELECT stop_id FROM used GROUP BY 1 HAVING min(client) <> max(client) AND min(dist) > 500 AND max(e - at) <= 900)), here AS (SELECT delivery, start, dist FROM pairs WHERE dist <= 400 AND e - start >= 900 QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY dist, stop_id) = 1),
 m AS (SELECT r.* REPLACE (CASE WHEN l.delivery IS NOT NULL THEN 'none' ELSE kind END AS kind, CASE WHEN l.delivery IS NOT NULL THEN 'pending' ELSE status END AS status, CASE WHEN l.delivery IS NULL THEN at END AS at, CASE WHEN l.delivery IS NOT NULL THEN 'short stop for several clients' END AS note) FROM rows r LEFT JOIN lost l USING (delivery))
 SELECT m.delivery, CASE WHEN status <> 'confirmed' AND h.start IS NOT NULL THEN 'short_proven' ELSE kind END AS kind, CASE WHEN h.start IS NOT NULL THEN 'confirmed' ELSE status END AS status, CASE WHEN status <> 'confirmed' AND h.start IS NOT NULL THEN h.start ELSE at END AS at,
  {i.hundredths_sql("CASE WHEN status <> 'confirmed' AND h.start IS NOT NULL THEN h.dist ELSE m.dist END")} AS dist, CASE WHEN status <> 'confirmed' AND h.start IS NOT NULL THEN NULL ELSE note END AS note FROM m LEFT JOIN here h USING (delivery)""")
def layer_short_stops(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    return _shown(cascade.short_stops(_timed(spark, d, pairs), pairs, 900, 500.0, 400.0))


@query(_ROWS + _TIMED + f", beyond AS (SELECT DISTINCT delivery FROM (SELECT delivery, row_number() OVER (PARTITION BY stop_id ORDER BY dist, delivery) AS r FROM used) WHERE r > 1) SELECT {_out(status='''CASE WHEN b.delivery IS NOT NULL THEN 'review' ELSE status END''', note='''CASE WHEN b.delivery IS NOT NULL THEN 'stop of several clients' ELSE note END''')} FROM rows LEFT JOIN (SELECT delivery FROM beyond) b USING (delivery)".replace("SELECT delivery, kind", "SELECT rows.delivery, kind"))
def layer_credited_once(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    return _shown(cascade.credited_once(_timed(spark, d, pairs), pairs, 1))


@query(_ROWS + f""", gaps AS (SELECT v AS vehicle, start AS gap_start, e AS gap_end FROM s WHERE e - start >= 900), g AS (SELECT DISTINCT delivery FROM base b JOIN gaps USING (vehicle) WHERE planned_at BETWEEN gap_start AND gap_end), l AS (SELECT vehicle, floor(avg(lat) * 1e7 + 0.5) / 1e7 AS y, floor(avg(lng) * 1e7 + 0.5) / 1e7 AS x FROM base GROUP BY vehicle, load),
 c AS (SELECT vehicle, min({{'y': y, 'x': x}}) AS a, max({{'y': y, 'x': x}}) AS b, min({{'x': x, 'y': y}}) AS e, max({{'x': x, 'y': y}}) AS f FROM l GROUP BY 1), w AS (SELECT vehicle FROM c WHERE greatest({i.haversine_sql('a.y', 'a.x', 'b.y', 'b.x')}, {i.haversine_sql('e.y', 'e.x', 'f.y', 'f.x')}) >= 5000)
 SELECT delivery, delivery IN (SELECT delivery FROM g) AS gap, vehicle IS NOT NULL AND vehicle IN (SELECT vehicle FROM w WHERE vehicle IS NOT NULL) AS split FROM base""")
def layer_marks(spark: SparkSession, d: str) -> DataFrame:
    gaps = i.stops(spark, d).where(F.col("end") - F.col("start") >= 900).select("vehicle", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"))
    return cascade.marked(_rows(spark, d), gaps, 5000.0).select("delivery", "gap", "split")


@query(_ROWS + f""", m AS (SELECT delivery, stop_id, start, e - start AS stay, d AS dist FROM (SELECT *, {_H} AS d FROM deliveries JOIN s ON vehicle = v) WHERE d <= 1500), n AS (SELECT * FROM m WHERE dist <= 900),
 far AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY stay DESC, stop_id) = 1), near AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY stay DESC, stop_id) = 1),
 snug AS (SELECT * FROM m WHERE dist <= 400 AND stay >= 180 QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY stay DESC, stop_id) = 1),
 l AS (SELECT far.delivery, coalesce(near.stop_id, far.stop_id) AS stop_id, coalesce(near.start, far.start) AS start, coalesce(near.dist, far.dist) AS dist, coalesce(near.stay, far.stay) AS stay, CASE WHEN near.delivery IS NULL THEN 'wide' ELSE 'ring' END AS via FROM far LEFT JOIN near USING (delivery)),
 b AS (SELECT l.delivery, CASE WHEN c THEN k.stop_id ELSE l.stop_id END AS stop_id, CASE WHEN c THEN k.start ELSE l.start END AS start, CASE WHEN c THEN k.dist ELSE l.dist END AS dist, via FROM (SELECT *, delivery AS x FROM l) l LEFT JOIN snug k USING (delivery), LATERAL (SELECT coalesce(NOT (l.dist <= 400 AND l.stay >= 180) AND l.dist - k.dist > 50, false) AS c) q),
 alt AS (SELECT delivery, stop_id, start, d AS dist, e - start AS stay FROM (SELECT delivery, stop_id, start, e, {i.haversine_sql('(lat + 0.02e0)', 'lng', 'lat_r', 'lng_r')} AS d FROM deliveries JOIN s ON vehicle = v WHERE delivery NOT IN (SELECT delivery FROM b)) WHERE d <= 900 QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY stay DESC, stop_id) = 1)
 SELECT delivery, stop_id, start, {i.hundredths_sql('dist')} AS dist, via FROM b UNION ALL SELECT delivery, stop_id, start, {i.hundredths_sql('dist')}, 'alternate' FROM alt""")
def inclusive_visits(spark: SparkSession, d: str) -> DataFrame:
    plan = i.deliveries(spark, d)
    got = evidence.inclusive_visits(plan, _stops(spark, d), plan.select("delivery", "vehicle", (F.col("lat") + 0.02).alias("lat"), "lng"), 900.0, 1500.0, 400.0)
    return got.select("delivery", "stop_id", "start", i.hundredths(F.col("dist")).alias("dist"), "via")
