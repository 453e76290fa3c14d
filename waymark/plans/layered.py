"""The composed cascade over all deliveries, and its SQL twin layer by layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import layers
from waymark.plans import inputs as i
from waymark.plans import linkage
from waymark.plans.cascade import query

LIMITS = layers.Limits(rotation=1000.0, rotation_least=1, rotation_percent=30, neighbour=1000.0, neighbour_s=60, share=150.0, share_s=60, signed_m=2000.0, signed_s=86400, base_m=3000.0, point=100.0, rural_point=400.0, short_s=600, short_far=100.0, address_s=7200, apart=12_000.0)
BASE = (-22.75, -43.05)
#: Metres from the point that a stop is at, by the last digit of its number to base 7.
OFFSETS = (0, 80, 200, 340, 800, 1300, 5000)
_N = LIMITS
_H = i.haversine_sql("lat", "lng", "lat_r", "lng_r")


def _quoted(kinds) -> str:
    return "(" + ", ".join(f"'{k}'" for k in kinds) + ")"


def _step(name: str, prev: str, hit: str, new: dict[str, str], joins: str = "") -> str:
    cases = ", ".join(f"CASE WHEN coalesce({hit}, false) THEN {v} ELSE r.{c} END AS {c}" for c, v in new.items())
    return f"{name} AS (SELECT r.* REPLACE ({cases}) FROM {prev} r {joins})"


def _crowd(metres: float) -> str:
    return f"(SELECT stop_id, min(client) AS lo, max(client) AS hi FROM pairs WHERE dist <= {metres} GROUP BY 1)"


_ALONE = "(lo IS NULL OR (lo = client AND hi = client))"
_BEST = {"status": "'confirmed'", "at": "b.start", "dist": "b.dist"}


def _passed(p: str, first: str, proofs: str) -> str:
    """The layers from the rows ``first`` on, under names that begin with ``p``."""
    pend = "r.status = 'pending' AND r.note IS NULL"
    best = lambda name, body, order: f"{name} AS (SELECT delivery, start, dist FROM {body} QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY {order}) = 1)"
    return ", ".join(
        [
            _step(f"{p}1", first, "r.vehicle IS NULL", {"kind": "'none'", "status": "'pending'", "at": "NULL", "dist": "NULL", "note": "'no vehicle'"}),
            _step(f"{p}2", f"{p}1", "r.delivery % 29 = 0 AND r.delivery % 23 <> 0 AND r.kind NOT IN ('own_ring', 'own_proven') AND r.note IS NULL", {"kind": "'target_done'", "status": "'confirmed'", "at": "NULL", "dist": "NULL"}),
            best(f"{p}b3", f"(SELECT * FROM pairs f LEFT JOIN {_crowd(_N.explains)} USING (stop_id) WHERE dist > {_N.isolated_low} AND e - start >= {_N.isolated_s} AND {_ALONE} AND NOT EXISTS (SELECT 1 FROM {proofs} q WHERE q.vehicle = f.vehicle AND q.client <> f.client AND least(q.e, f.e) > greatest(q.start, f.start)))", "start - e, dist, stop_id"),
            _step(f"{p}3", f"{p}2", f"{pend} AND b.start IS NOT NULL", _BEST | {"kind": "'isolated'", "note": "'nearby stop'"}, f"LEFT JOIN {p}b3 b USING (delivery)"),
            f"{p}4 AS (SELECT r.* REPLACE (CASE WHEN c AND h.start IS NOT NULL THEN 'rotation' ELSE kind END AS kind, CASE WHEN c AND h.start IS NOT NULL THEN 'confirmed' ELSE status END AS status, CASE WHEN c THEN h.start ELSE at END AS at, CASE WHEN c AND h.start IS NOT NULL THEN h.d ELSE dist END AS dist, CASE WHEN NOT c THEN note WHEN h.start IS NOT NULL THEN 'rotation' ELSE 'plan plate did not pass' END AS note) FROM (SELECT r.*, {pend} AND t.by IS NOT NULL AS c FROM {p}3 r LEFT JOIN top t USING (load)) r LEFT JOIN hit h USING (delivery))",
            _step(f"{p}5", f"(SELECT * EXCLUDE (c) FROM {p}4)", "r.vehicle % 7 = 0 AND r.status = 'pending' AND NOT coalesce(r.note IN ('no vehicle', 'plan plate did not pass'), false)", {"note": "'waiting'"}),
            f"{p}n AS (SELECT * FROM pairs WHERE e - start >= {_N.neighbour_s} AND dist <= {_N.neighbour})",
            best(f"{p}b6", f"{p}n WHERE stop_id IN (SELECT stop_id FROM {p}n GROUP BY 1 HAVING min(client) <> max(client))", "dist, stop_id"),
            _step(f"{p}6", f"{p}5", f"{pend} AND b.start IS NOT NULL", _BEST | {"kind": "'neighbour'", "note": "'shared with a neighbour'"}, f"LEFT JOIN {p}b6 b USING (delivery)"),
            best(f"{p}b7", f"pairs WHERE dist <= {_N.share} AND e - start >= {_N.share_s}", "start - e, dist, stop_id"),
            _step(f"{p}7", f"{p}6", "r.kind = 'shared' AND r.status = 'review' AND b.start IS NOT NULL", _BEST | {"kind": "'own_proven'"}, f"LEFT JOIN {p}b7 b USING (delivery)"),
            f"{p}l8 AS (SELECT * FROM (SELECT p.*, CASE WHEN delivery % 23 = 0 THEN planned_at + 600 ELSE planned_at + 40000 END AS signed FROM pairs p JOIN deliveries USING (delivery) WHERE delivery % 23 = 0 OR delivery % 29 = 0) WHERE dist <= {_N.signed_m} AND e <= signed AND e >= signed - {_N.signed_s} QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY e DESC, stop_id DESC) = 1)",
            f"{p}b8 AS (SELECT delivery, start, dist FROM {p}l8 LEFT JOIN {_crowd(_N.dispute)} USING (stop_id) WHERE {_ALONE})",
            _step(f"{p}8", f"{p}7", "r.kind = 'target_done' AND r.at IS NULL AND b.start IS NOT NULL", {"kind": "'before_sign_off'", "at": "b.start", "dist": "b.dist"}, f"LEFT JOIN {p}b8 b USING (delivery)"),
            f"{p}o AS (SELECT DISTINCT delivery FROM {p}8 r JOIN pairs p USING (delivery) JOIN {_crowd(_N.at_address)} c USING (stop_id) WHERE p.start = r.at AND p.dist > {_N.explains} AND (lo <> p.client OR hi <> p.client))",
            f"""{p}w AS (SELECT r.*, CASE WHEN r.status <> 'confirmed' THEN NULL WHEN apart AND proof IS NULL AND kind IN ('own_ring', 'own_proven') THEN 'visited the registry only' WHEN apart AND proof IS NULL THEN 'registry far from address' WHEN vehicle % 7 = 0 AND dist > {_N.running_far} THEN 'waiting'
  WHEN {i.haversine_sql("lat", "lng", f"{BASE[0]}e0", f"{BASE[1]}e0")} <= {_N.base_m} AND proof IS NULL THEN 'client inside base' WHEN others IS NOT NULL AND kind NOT IN ('own_ring', 'own_proven') THEN 'stop of another client' WHEN kind IN ('isolated', 'neighbour') AND delivery % 17 = 0 THEN 'another outcome'
  WHEN kind = 'other_vehicle' AND dist > {_N.owner_m} THEN 'weak and far' WHEN same IS NOT NULL AND kind NOT IN ('own_ring', 'own_proven', 'isolated', 'neighbour') THEN 'repeated registry point' END AS why
  FROM (SELECT r.*, coalesce({i.haversine_sql("lat", "lng", "g.reg_lat", "g.reg_lng")} > {_N.registry_far}, false) AS apart, pr.delivery AS proof, o.delivery AS others, m.reg_lat AS same FROM {p}8 r LEFT JOIN reg g USING (client) LEFT JOIN same m ON m.reg_lat = g.reg_lat AND m.reg_lng = g.reg_lng
   LEFT JOIN (SELECT DISTINCT delivery FROM pairs WHERE dist <= {_N.at_address} AND e - start >= 120) pr USING (delivery) LEFT JOIN {p}o o ON o.delivery = r.delivery) r)""",
            f"{p}9 AS (SELECT r.* EXCLUDE (why, apart, proof, others, same) REPLACE (CASE WHEN why = 'waiting' THEN 'pending' WHEN why IS NOT NULL THEN 'review' ELSE status END AS status, CASE WHEN why = 'waiting' THEN NULL ELSE at END AS at, coalesce(why, note) AS note) FROM {p}w r)",
        ]
    )


_REG = "reg AS (SELECT client, any_value(lat + CASE WHEN client % 9 = 0 THEN 0.02e0 ELSE 0e0 END) AS reg_lat, any_value(lng) AS reg_lng FROM (SELECT CASE WHEN client % 12 = 5 THEN client - 1 ELSE client END AS c2, client FROM deliveries) r JOIN (SELECT client AS c2, any_value(lat) AS lat, any_value(lng) AS lng FROM deliveries GROUP BY 1) USING (c2) GROUP BY client), same AS (SELECT reg_lat, reg_lng FROM reg GROUP BY ALL HAVING count(DISTINCT client) > 1)"
_LAT, _LNG = (lambda c: f"(-22.9e0 + ({c}) * 41 % 97 * 0.003e0)"), (lambda c: f"(-43.2e0 + ({c}) * 59 % 89 * 0.003e0)")
_PLACE = "(((vehicle + CASE WHEN stop_id % 5 = 0 THEN 1 ELSE 0 END) % 150 + 150 * (stop_id % 30)) // 2)"
_PLAN = f"{i.DELIVERIES.replace('deliveries AS', 'deliveries0 AS')}, deliveries AS (SELECT delivery, client, CASE WHEN delivery % 31 <> 0 THEN vehicle END AS vehicle, delivery % 150 * 3 + delivery // 150 % 3 AS load, {_LAT('client')} AS lat, {_LNG('client')} AS lng, planned_at, client % 3 = 0 AS rural FROM deliveries0)"
_PROOFS = lambda rows: f"(SELECT DISTINCT p.vehicle, p.client, p.start, p.e FROM pairs p JOIN {rows} r USING (delivery) WHERE r.status = 'confirmed' AND r.kind IN {_quoted(layers.PROOF)} AND r.at = p.start)"
SQL = f"""WITH {i.STOPS}, {_PLAN}, s AS (SELECT stop_id, CASE WHEN vehicle % 10 = 9 THEN vehicle - 1 ELSE vehicle END AS v, start, "end" AS e, {_LAT(_PLACE)} + ([{", ".join(map(str, OFFSETS))}])[stop_id % 7 + 1] / 111195e0 AS lat_r, {_LNG(_PLACE)} AS lng_r FROM stops){linkage._OWN}, {_REG},
 first AS (SELECT p.*, kind, status, c.at AS at, c.d AS dist, CAST(NULL AS VARCHAR) AS note FROM deliveries p JOIN decided c USING (delivery)),
 pairs AS (SELECT delivery, vehicle, client, stop_id, start, e, d AS dist FROM (SELECT *, {_H} AS d FROM deliveries JOIN s ON vehicle = v) WHERE d <= {_N.isolated_high}),
 explained AS (SELECT stop_id FROM deliveries JOIN s ON vehicle = v WHERE e - start <= {_N.longest_s} AND {_H} <= {_N.executor_explains}),
 total AS (SELECT load, count(*) AS n FROM first GROUP BY 1 HAVING bool_and(status = 'pending')),
 met AS (SELECT load, n, v AS by, delivery, stop_id, start, d FROM (SELECT f.load, f.delivery, f.vehicle, n, s.*, {_H} AS d FROM first f JOIN total USING (load) JOIN s ON s.start // 86400 = f.planned_at // 86400 WHERE f.status = 'pending' AND e - start <= {_N.longest_s} AND stop_id NOT IN (SELECT stop_id FROM explained)) WHERE v <> vehicle AND d <= {_N.rotation}),
 near AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY load, by, delivery ORDER BY d, stop_id) = 1),
 top AS (SELECT load, by FROM (SELECT load, by, n, count(*) AS c FROM near GROUP BY load, by, n HAVING count(*) >= {_N.rotation_least} AND 100 * count(*) >= {_N.rotation_percent} * n) QUALIFY row_number() OVER (PARTITION BY load ORDER BY c DESC, by DESC) = 1),
 hit AS (SELECT delivery, start, d FROM near JOIN top USING (load, by)),
 proof1 AS {_PROOFS("first")}, {_passed("a", "first", "proof1")}, proof2 AS {_PROOFS("a9")},
 doubted AS (SELECT DISTINCT delivery FROM a9 r JOIN pairs p USING (delivery) WHERE r.kind = 'isolated' AND p.start = r.at AND EXISTS (SELECT 1 FROM proof2 q WHERE q.vehicle = p.vehicle AND q.client <> p.client AND least(q.e, p.e) > greatest(q.start, p.start))),
 second AS (SELECT * FROM first WHERE delivery IN (SELECT delivery FROM doubted)), {_passed("b", "second", "proof2")},
 twice AS (SELECT *, false AS again FROM a9 WHERE delivery NOT IN (SELECT delivery FROM doubted) UNION ALL BY NAME SELECT *, true AS again FROM b9),
 used AS (SELECT r.delivery, r.client, p.stop_id, p.dist FROM twice r JOIN pairs p USING (delivery) WHERE r.status = 'confirmed' AND r.kind IN ('isolated', 'neighbour', 'before_sign_off') AND p.start = r.at AND p.e - p.start <= {_N.short_s}),
 lost AS (SELECT DISTINCT delivery FROM used WHERE stop_id IN (SELECT stop_id FROM used GROUP BY 1 HAVING min(client) <> max(client) AND min(dist) > {_N.short_far})),
 {_step("g1", "twice", "l.delivery IS NOT NULL", {"status": "'pending'", "at": "NULL", "note": "'short stop for several clients'"}, "LEFT JOIN lost l ON l.delivery = r.delivery")},
 here AS (SELECT delivery, start, dist FROM pairs p JOIN (SELECT delivery, rural FROM deliveries) USING (delivery) LEFT JOIN {_crowd(_N.at_address)} USING (stop_id) WHERE e - start >= {_N.short_s} AND dist <= CASE WHEN rural THEN {_N.rural_point} ELSE {_N.point} END AND {_ALONE} QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY dist, stop_id) = 1),
 {_step("g2", "g1", "r.status = 'review' AND NOT coalesce(r.note = 'repeated registry point', false) AND b.start IS NOT NULL", _BEST | {"kind": "'short_proven'", "note": "'stop on the point'"}, "LEFT JOIN here b USING (delivery)")},
 taken AS (SELECT a.delivery, arg_min(b.at, (abs(a.planned_at - b.planned_at), b.planned_at)) AS at2 FROM g2 a JOIN g2 b ON a.client = b.client AND a.delivery <> b.delivery AND b.status = 'confirmed' AND a.status <> 'confirmed' WHERE abs(a.planned_at - b.planned_at) <= {_N.address_s} GROUP BY 1),
 g3 AS (SELECT r.* REPLACE (CASE WHEN t.delivery IS NOT NULL THEN 'same_address' ELSE kind END AS kind, CASE WHEN t.delivery IS NOT NULL THEN 'confirmed' ELSE status END AS status, CASE WHEN t.delivery IS NOT NULL THEN at2 ELSE r.at END AS at) FROM g2 r LEFT JOIN taken t ON t.delivery = r.delivery),
 gaps AS (SELECT v, start AS gap_start, e AS gap_end FROM s WHERE e - start >= 900), g AS (SELECT DISTINCT delivery FROM deliveries JOIN gaps ON vehicle = v WHERE planned_at BETWEEN gap_start AND gap_end),
 l AS (SELECT vehicle, floor(avg(lat) * 1e7 + 0.5) / 1e7 AS y, floor(avg(lng) * 1e7 + 0.5) / 1e7 AS x FROM deliveries WHERE vehicle IS NOT NULL GROUP BY vehicle, load),
 c AS (SELECT vehicle, min({{'y': y, 'x': x}}) AS a, max({{'y': y, 'x': x}}) AS b, min({{'x': x, 'y': y}}) AS e, max({{'x': x, 'y': y}}) AS f FROM l GROUP BY 1), w AS (SELECT vehicle FROM c WHERE greatest({i.haversine_sql("a.y", "a.x", "b.y", "b.x")}, {i.haversine_sql("e.y", "e.x", "f.y", "f.x")}) >= {_N.apart})
 SELECT delivery, kind, status, at, {i.hundredths_sql("dist")} AS dist, note, delivery IN (SELECT delivery FROM g) AS gap, vehicle IS NOT NULL AND vehicle IN (SELECT vehicle FROM w) AS split, coalesce(vehicle % 11 = 0, false) AS faulty, again FROM g3"""


@query(SQL)
def composed_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery through layers 0 to 8, with the second pass; stops lie around the clients of their vehicle, of the next one, or of one that drove none itself."""
    p = i.deliveries(spark, d)
    lat, lng = (lambda c: F.lit(-22.9) + c * 41 % 97 * 0.003), (lambda c: F.lit(-43.2) + c * 59 % 89 * 0.003)
    plan = p.select("delivery", "client", F.when(F.col("delivery") % 31 != 0, F.col("vehicle")).alias("vehicle"), (F.col("delivery") % 150 * 3 + F.floor(F.col("delivery") / 150) % 3).alias("load"), lat(F.col("client")).alias("lat"), lng(F.col("client")).alias("lng"), "planned_at", (F.col("client") % 3 == 0).alias("rural"))
    k = F.col("stop_id")
    place = F.floor(((F.col("vehicle") + F.when(k % 5 == 0, 1).otherwise(0)) % 150 + 150 * (k % 30)) / 2)
    offset = F.element_at(F.array(*map(F.lit, OFFSETS)), (k % 7 + 1).cast("int")) / 111195
    stops = i.stops(spark, d).select("stop_id", F.when(F.col("vehicle") % 10 == 9, F.col("vehicle") - 1).otherwise(F.col("vehicle")).alias("vehicle"), "start", "end", (lat(place) + offset).alias("lat_r"), lng(place).alias("lng_r"))
    timed = F.col("delivery") % 23 == 0
    done = plan.where("delivery % 23 = 0 or delivery % 29 = 0").select("delivery", F.when(timed, F.col("planned_at") + 600).alias("at"), (F.col("planned_at") + F.when(timed, 600).otherwise(40000)).alias("signed"))
    c = F.col("client")
    point = F.when(c % 12 == 5, c - 1).otherwise(c)
    known = plan.select(F.col("client").alias("point")).distinct()
    registry = plan.select("client", point.alias("point")).distinct().join(known, "point").select("client", (lat(F.col("point")) + F.when(c % 9 == 0, 0.02).otherwise(0.0)).alias("reg_lat"), lng(F.col("point")).alias("reg_lng"))
    gaps = stops.where(F.col("end") - F.col("start") >= 900).select("vehicle", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"))
    vehicles = lambda n: plan.where(F.col("vehicle") % n == 0).select("vehicle")
    rows = layers.composed(plan, stops, done, registry, vehicles(7), plan.where("delivery % 17 = 0").select("delivery"), gaps, vehicles(11), BASE, LIMITS)
    return rows.withColumn("dist", i.hundredths(F.col("dist")))
