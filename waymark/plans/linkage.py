"""Queries of joins, evidence and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import haversine, planar
from waymark.functions.text import ocr_variants, series_variants
from waymark.operators import evidence, joins
from waymark.plans import inputs as i
from waymark.plans.catalog import query
from waymark.sources.store import kept, table

_H = i.haversine_sql("lat", "lng", "lat_r", "lng_r")
_P = "(sqrt((lat - lat_r) * (lat - lat_r) + (lng - lng_r) * (lng - lng_r)) * 111000e0)"


@query("""WITH a AS (SELECT o_orderkey % 500 AS load, o_custkey % 40 AS vehicle, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL), b AS (SELECT o_orderkey % 500 AS load, o_custkey % 40 AS vehicle, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL)
 SELECT coalesce(a.load, b.load) AS load, coalesce(a.vehicle, b.vehicle) AS vehicle, CAST(a.n AS BIGINT) AS n_left, CAST(b.n AS BIGINT) AS n_right, CASE WHEN b.n IS NULL THEN 'missing_right' WHEN a.n IS NULL THEN 'missing_left' ELSE 'count' END AS kind
 FROM a FULL JOIN b ON a.load = b.load AND a.vehicle = b.vehicle WHERE a.n IS NULL OR b.n IS NULL OR a.n <> b.n""")
def plan_mismatches(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 500).alias("load"), (F.col("o_custkey") % 40).alias("vehicle"), "o_orderstatus", F.lit(1).alias("one"))
    return joins.mismatches(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus <> 'O'"), ["load", "vehicle"], "one")


@query(f"WITH {i.STOPS}, {i.STORES} SELECT stop_id, store_id, {i.hundredths_sql('d')} AS dist FROM (SELECT stop_id, store_id, {_H} AS d FROM stops, stores) WHERE d <= 500 QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY d, store_id) = 1")
def nearest_store(spark: SparkSession, d: str) -> DataFrame:
    got = joins.nearest(i.stops(spark, d), i.stores(spark, d), ["stop_id"], [], 500.0, haversine, ["store_id"])
    return got.select("stop_id", "store_id", i.hundredths(F.col("dist")).alias("dist"))


@query(f"WITH {i.STOPS}, {i.STORES} SELECT stop_id, store_id, {i.hundredths_sql('d')} AS dist FROM (SELECT stop_id, store_id, radius, {_P} AS d FROM stops, stores) WHERE d <= greatest(radius, 150) + 30 QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY d, store_id) = 1")
def geofence_of_stop(spark: SparkSession, d: str) -> DataFrame:
    met = joins.range_join(i.stops(spark, d), i.stores(spark, d), [], 330.0, planar)
    got = joins.best_per(met.where(F.col("dist") <= F.greatest("radius", F.lit(150)) + 30), ["stop_id"], [F.col("dist"), F.col("store_id")])
    return got.select("stop_id", "store_id", i.hundredths(F.col("dist")).alias("dist"))


@query(f"WITH {i.STOPS}, {i.STORES} SELECT stop_id, store_id, via FROM (SELECT stop_id, store_id, d, CASE WHEN d <= 100 THEN 'near' ELSE 'address' END AS via FROM (SELECT stop_id, store_id, {_H} AS d FROM stops, stores) WHERE d <= 100 OR (d <= 250 AND stop_id % 5 = store_id % 5)) QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY d, store_id) = 1")
def geo_and_address(spark: SparkSession, d: str) -> DataFrame:
    met = joins.range_join(i.stops(spark, d), i.stores(spark, d), [], 250.0, haversine)
    met = met.where((F.col("dist") <= 100) | (F.col("stop_id") % 5 == F.col("store_id") % 5))
    return joins.best_per(met, ["stop_id"], [F.col("dist"), F.col("store_id")]).select("stop_id", "store_id", F.when(F.col("dist") <= 100, "near").otherwise("address").alias("via"))


@query(f"WITH {i.STOPS}, {i.STORES}, n AS (SELECT DISTINCT stop_id FROM stops, stores WHERE {_H} <= 400) SELECT stop_id FROM stops WHERE stop_id NOT IN (SELECT stop_id FROM n)")
def isolated_stops(spark: SparkSession, d: str) -> DataFrame:
    return joins.isolated(i.stops(spark, d), i.stores(spark, d), ["stop_id"], [], 400.0, haversine).select("stop_id")


_DONE = f"WITH {i.STOPS}, {i.DELIVERIES}, done AS (SELECT delivery, vehicle, planned_at AS t FROM deliveries)"


@query(_DONE + """ SELECT delivery, stop_id FROM done JOIN stops USING (vehicle) WHERE t BETWEEN start AND "end" """)
def sign_off_inside_stop(spark: SparkSession, d: str) -> DataFrame:
    done = i.deliveries(spark, d).select("delivery", "vehicle", F.col("planned_at").alias("t"))
    return joins.interval_join(done, i.stops(spark, d), ["vehicle"], "t", "start", "end", 1800).select("delivery", "stop_id")


@query(_DONE + """ SELECT delivery, stop_id, inside FROM (SELECT delivery, stop_id, start, t, t BETWEEN start AND "end" AS inside FROM done JOIN stops USING (vehicle)) WHERE inside OR abs(t - start) <= 300 QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY CAST(inside AS INT) DESC, CASE WHEN inside THEN -start ELSE abs(t - start) END, stop_id) = 1""")
def arrival_stop(spark: SparkSession, d: str) -> DataFrame:
    done = i.deliveries(spark, d).select("delivery", "vehicle", F.col("planned_at").alias("t"))
    return joins.nearest_in_time(done, i.stops(spark, d), ["vehicle"], ["delivery"], "t", "start", "end", 300, ["stop_id"]).select("delivery", "stop_id", "inside")


@query(_DONE + " SELECT delivery, CASE WHEN t - start <= 7200 THEN start END AS start, CASE WHEN t - start <= 7200 THEN stop_id END AS stop_id FROM done ASOF LEFT JOIN stops ON done.vehicle = stops.vehicle AND done.t >= stops.start")
def last_stop_before(spark: SparkSession, d: str) -> DataFrame:
    done = i.deliveries(spark, d).select("delivery", "vehicle", F.col("planned_at").alias("t"))
    return joins.as_of(done, i.stops(spark, d), ["vehicle"], "t", "start", ["stop_id"], "stop_id", 7200).select("delivery", "start", "stop_id")


@query(f"""WITH {i.STOPS}, a AS (SELECT * FROM stops WHERE stop_id % 2 = 0), b AS (SELECT * FROM stops WHERE stop_id % 2 = 1)
 SELECT a.stop_id, b.stop_id AS other, least(a."end", b."end") - greatest(a.start, b.start) AS overlap FROM a JOIN b USING (vehicle) WHERE least(a."end", b."end") > greatest(a.start, b.start) QUALIFY row_number() OVER (PARTITION BY a.stop_id ORDER BY overlap DESC, b.stop_id) = 1""")
def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).select("stop_id", "vehicle", "start", "end")
    other = s.where("stop_id % 2 = 1").select("vehicle", F.col("stop_id").alias("other"), F.col("start").alias("start_r"), F.col("end").alias("end_r"))
    met = joins.overlap_join(s.where("stop_id % 2 = 0"), other, ["vehicle"], 1800)
    return joins.best_per(met, ["stop_id"], [F.col("overlap").desc(), F.col("other")]).select("stop_id", "other", "overlap")


@query(f"""WITH {i.STOPS}, c AS (SELECT store, max(stop_id) AS ref FROM stops WHERE store < 12 GROUP BY store), n AS (SELECT vehicle, max(stop_id) AS ref FROM stops WHERE vehicle % 3 = 0 GROUP BY vehicle), k AS (SELECT kind, max(stop_id) AS ref FROM stops WHERE kind <> 'BASE' GROUP BY kind)
 SELECT stop_id, coalesce(c.ref, n.ref, k.ref) AS ref, CASE WHEN c.ref IS NOT NULL THEN 'code' WHEN n.ref IS NOT NULL THEN 'name' WHEN k.ref IS NOT NULL THEN 'kind' END AS via FROM stops s LEFT JOIN c ON s.store = c.store LEFT JOIN n ON s.vehicle = n.vehicle LEFT JOIN k ON s.kind = k.kind""")
def fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d)
    best = lambda rows, on: rows.groupBy(on).agg(F.max("stop_id").alias("ref"))
    steps = [("code", best(s.where("store < 12"), "store"), ["store"]), ("name", best(s.where("vehicle % 3 = 0"), "vehicle"), ["vehicle"]), ("kind", best(s.where("kind <> 'BASE'"), "kind"), ["kind"])]
    return joins.fallback_join(s, ["stop_id"], steps, "ref").select("stop_id", "ref", "via")


@query("SELECT c_mktsegment || '-' || CAST(c_custkey % 300 AS VARCHAR) AS code, min(c_nationkey) AS nation FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) = 1")
def unambiguous_codes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat_ws("-", "c_mktsegment", (F.col("c_custkey") % 300).cast("string")).alias("code"), F.col("c_nationkey").alias("nation"))
    return joins.unambiguous(c, ["code"], "nation")


_SUF = f"WITH a AS (SELECT c_custkey AS id, {i.plate_sql('c_custkey')} AS plate FROM customer), b AS (SELECT DISTINCT {i.plate_sql('s_suppkey * 7 + 3')} AS known FROM supplier)"


@query(_SUF + ", e AS (SELECT right(known, 4) AS tail, min(known) AS known FROM b GROUP BY 1 HAVING count(*) = 1) SELECT id, plate, known FROM a JOIN e ON right(plate, 4) = tail")
def unique_suffix(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), i.plate_of("c_custkey").alias("plate"))
    b = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey") * 7 + 3).select(i.plate_of("k").alias("known"))
    return joins.suffix_join(a, b, "plate", "known", 4).select("id", "plate", "known")


@query()
def plate_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Exact plate, then misread, then other series; only where one known plate answers."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), i.plate_of("c_custkey").alias("plate"))
    known = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey") * 7 + 3).select(i.plate_of("k").alias("known")).distinct()
    tries = [a.select("id", "plate", F.col("plate").alias("known")), a.select("id", "plate", F.explode(ocr_variants(F.col("plate"))).alias("known")), a.select("id", "plate", F.explode(series_variants(F.col("plate"))).alias("known"))]
    return joins.prioritised([t.join(known, "known") for t in tries], ["id"], [F.col("known")]).select("id", "plate", "known", "priority")


_TRI = """WITH n AS (SELECT DISTINCT p_name AS name FROM part), m AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS other FROM part),
 g AS (SELECT name, list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN string_split(name, ' ')])) AS a FROM n), h AS (SELECT other, list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN string_split(other, ' ')])) AS b FROM m)"""


@query(_TRI + ", p AS (SELECT name, other, len(list_intersect(a, b)) AS k, len(a) + len(b) - len(list_intersect(a, b)) AS u FROM g, h) SELECT name, other, CAST(100 * k // u AS BIGINT) AS score FROM p WHERE 100 * k >= 60 * u")
def trigram_matches(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return joins.trigram_join(p.select(F.col("p_name").alias("name")), p.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("other")), "name", "other", 60)


@query(f"""WITH {i.STOPS}, a AS (SELECT * FROM stops WHERE kind <> 'STORE'), b AS (SELECT * FROM stops WHERE kind = 'STORE'),
 n AS (SELECT DISTINCT b.stop_id FROM b JOIN a USING (vehicle) WHERE abs(a.start - b.start) <= 3600 AND {i.haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 2000)
 SELECT stop_id FROM a UNION ALL SELECT stop_id FROM b WHERE stop_id NOT IN (SELECT stop_id FROM n)""")
def source_dedup_union(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).select("stop_id", "vehicle", "kind", "lat", "lng", F.col("start").alias("t"))
    return joins.without_near_repeats(s.where("kind <> 'STORE'"), s.where("kind = 'STORE'"), ["vehicle"], ["stop_id"], 2000.0, 3600, haversine).select("stop_id")


_COV = f"""WITH {i.STOPS}, {i.DELIVERIES}, v AS (SELECT vehicle AS mate, start // 86400 AS day, lat AS lat_r, lng AS lng_r FROM stops), p AS (SELECT vehicle AS load, planned_at // 86400 AS day, delivery, lat, lng FROM deliveries),
 c AS (SELECT day, load, mate, count(DISTINCT delivery) AS covered FROM p JOIN v USING (day) WHERE {_H} <= 500 AND load <> mate GROUP BY ALL),
 t AS (SELECT day, load, count(*) AS total FROM p GROUP BY ALL), k AS (SELECT day, load, mate, covered, total FROM c JOIN t USING (day, load) WHERE covered >= 2 AND 100 * covered >= 40 * total)"""


def _cover(spark: SparkSession, d: str) -> DataFrame:
    day = lambda t: F.floor(F.col(t) / 86400).alias("day")
    points = i.deliveries(spark, d).select(day("planned_at"), F.col("vehicle").alias("load"), F.col("delivery").alias("point_id"), "lat", "lng")
    other = i.stops(spark, d).select(day("start"), F.col("vehicle").alias("mate"), F.col("lat").alias("lat_r"), F.col("lng").alias("lng_r"))
    return joins.coverage(points, other, "load", "mate", 500.0, haversine, 40, 2, ["day"]).where("load <> mate")


@query(_COV + " SELECT * FROM k")
def swap_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _cover(spark, d)


@query(_COV + ", m AS (SELECT *, max(covered) OVER (PARTITION BY day, load) AS top FROM k), n AS (SELECT *, count(*) OVER (PARTITION BY day, load) AS tied FROM m WHERE covered = top) SELECT day, load, mate, covered, total FROM n WHERE tied = 1")
def swap_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return joins.only_leader(_cover(spark, d), ["day", "load"], "covered")


_HIST = "history AS (SELECT l_orderkey % 400 AS entry, CASE WHEN l_linestatus = 'F' THEN 'undo' ELSE l_returnflag END AS verdict, l_orderkey * 10 + l_linenumber AS made, l_partkey AS tie, l_suppkey AS tie2 FROM lineitem)"


@query(f"WITH {i.ENTRIES}, {_HIST}, l AS (SELECT entry, verdict FROM history QUALIFY row_number() OVER (PARTITION BY entry ORDER BY made DESC, tie DESC, tie2 DESC, verdict DESC) = 1) SELECT e.entry, coalesce(l.verdict, e.status) AS status, l.verdict IS NOT NULL AS changed FROM entries e LEFT JOIN l ON e.entry = l.entry AND l.verdict <> 'undo'")
def manual_overlay(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    history = table(spark, d, "lineitem").select((k % 400).alias("entry"), F.when(F.col("l_linestatus") == "F", "undo").otherwise(F.col("l_returnflag")).alias("status"), (k * 10 + F.col("l_linenumber")).alias("made"), F.col("l_partkey").alias("tie"), F.col("l_suppkey").alias("tie2"))
    return joins.overlay(i.entries(spark, d).select("entry", "status"), history, ["entry"], ["made", "tie", "tie2", "status"], "status", "undo")


@query(f"WITH {i.ENTRIES} SELECT entry, CASE WHEN entry % 6 = 0 THEN NULL WHEN entry % 6 = 1 THEN 'bridge' ELSE leave END AS leave FROM entries")
def present_null_override(spark: SparkSession, d: str) -> DataFrame:
    e = i.entries(spark, d)
    told = e.where("entry % 6 < 2").select("entry", F.when(F.col("entry") % 6 == 1, "bridge").alias("leave"))
    return joins.present_wins(e.select("entry", "leave"), told, ["entry"], "leave")


_OTHERS = f"WITH {i.STOPS}, {i.DELIVERIES}, s AS (SELECT stop_id, vehicle AS v, start, \"end\" AS e, lat AS lat_r, lng AS lng_r FROM stops)"


@query(_OTHERS + f", m AS (SELECT delivery, stop_id, v, {_H} AS d FROM deliveries, s WHERE vehicle <> v AND e - start >= 120 AND start // 86400 = planned_at // 86400) SELECT delivery, stop_id, v AS by FROM m WHERE d <= 300 QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY d, stop_id) = 1")
def other_vehicle_stop(spark: SparkSession, d: str) -> DataFrame:
    return evidence.other_vehicle_stop(i.deliveries(spark, d), _evidence_stops(spark, d)).select("delivery", "stop_id", "by")


def _evidence_stops(spark: SparkSession, d: str) -> DataFrame:
    return i.stops(spark, d).select("stop_id", "vehicle", "start", "end", F.col("lat").alias("lat_r"), F.col("lng").alias("lng_r"))


_OWN = f""", own1 AS (SELECT delivery, client, stop_id, start, e, d, min(CASE WHEN d <= 150 THEN {{'d': d, 'c': client}} END) OVER (PARTITION BY stop_id) AS o FROM (SELECT *, {_H} AS d FROM deliveries JOIN s ON vehicle = v) WHERE d <= 350 AND e - start >= 120),
 own AS (SELECT *, CASE WHEN d <= 100 THEN 1 WHEN d <= 300 THEN 2 ELSE 3 END AS ring FROM own1 WHERE o IS NULL OR o.c = client OR d <= o.d QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY ring, start - e, d, stop_id) = 1),
 sh1 AS (SELECT delivery, client, stop_id, start, e, d FROM (SELECT *, {_H} AS d FROM deliveries JOIN s ON vehicle = v) WHERE d <= 150 AND e - start BETWEEN 120 AND 3600), sc AS (SELECT stop_id, count(DISTINCT client) AS c FROM sh1 GROUP BY 1),
 sh AS (SELECT * FROM sh1 JOIN sc USING (stop_id) WHERE c > 1 AND d <= 100 QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY start - e, d, stop_id) = 1),
 ot AS (SELECT * FROM (SELECT *, {_H} AS d FROM deliveries, s WHERE vehicle <> v AND e - start >= 120 AND start // 86400 = planned_at // 86400) WHERE d <= 300 QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY d, stop_id) = 1),
 ne AS (SELECT * FROM (SELECT *, {_H} AS d FROM deliveries JOIN s ON vehicle = v) WHERE d <= 2000 QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY d, stop_id) = 1),
 k AS (SELECT p.*, own.start AS t_own, own.d AS d_own, CASE WHEN p.delivery % 23 = 0 THEN p.planned_at + 600 END AS t_done, sh.start AS t_sh, sh.d AS d_sh, ot.start AS t_ot, ot.d AS d_ot, ne.d AS d_ne,
  CASE WHEN ring <= 2 THEN 'own_ring' WHEN ring = 3 THEN 'own_proven' WHEN p.delivery % 23 = 0 THEN 'target_done' WHEN sh.start IS NOT NULL THEN 'shared' WHEN ot.start IS NOT NULL THEN 'other_vehicle' WHEN ne.d <= 500 THEN 'wide_ring' WHEN ne.d IS NOT NULL THEN 'near' ELSE 'none' END AS kind
  FROM deliveries p LEFT JOIN own USING (delivery) LEFT JOIN sh USING (delivery) LEFT JOIN ot USING (delivery) LEFT JOIN ne USING (delivery)),
 decided AS (SELECT delivery, client, planned_at, kind, CASE WHEN kind IN ('own_ring', 'own_proven', 'target_done', 'other_vehicle') THEN 'confirmed' WHEN kind IN ('shared', 'wide_ring') THEN 'review' ELSE 'pending' END AS status,
  coalesce(t_own, t_done, CASE WHEN kind = 'shared' THEN t_sh END, CASE WHEN kind = 'other_vehicle' THEN t_ot END) AS at, coalesce(d_own, CASE WHEN kind = 'shared' THEN d_sh END, CASE WHEN kind = 'other_vehicle' THEN d_ot END, d_ne) AS d FROM k)"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    p = i.deliveries(spark, d)
    targets = p.where("delivery % 23 = 0").select("delivery", (F.col("planned_at") + 600).alias("at"))
    return evidence.decided(p, _evidence_stops(spark, d), targets)


@query(_OTHERS + _OWN + f" SELECT delivery, kind, status, decided.at AS at, {i.hundredths_sql('d')} AS dist FROM decided")
def evidence_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("delivery", "kind", "status", "at", i.hundredths(F.col("dist")).alias("dist"))


@query(_OTHERS + _OWN + """, n AS (SELECT a.delivery, b.at, abs(a.planned_at - b.planned_at) AS gap FROM decided a JOIN decided b ON a.client = b.client AND a.delivery <> b.delivery AND b.status = 'confirmed' AND a.status <> 'confirmed' WHERE abs(a.planned_at - b.planned_at) <= 7200)
 SELECT delivery, CASE WHEN gap IS NOT NULL THEN 'same_address' ELSE kind END AS kind, CASE WHEN gap IS NOT NULL THEN 'confirmed' ELSE status END AS status, CASE WHEN gap IS NOT NULL THEN n.at ELSE decided.at END AS at FROM decided LEFT JOIN n USING (delivery)""")
def same_address_pass(spark: SparkSession, d: str) -> DataFrame:
    return evidence.taken_up(kept(_decided(spark, d), "decided"), ["client"], 7200).select("delivery", "kind", "status", "at")


@query(f"""WITH {i.STOPS}, {i.STORES}, n AS (SELECT stop_id, vehicle, store_id FROM stops, stores WHERE {_H} <= 500) SELECT stop_id, store_id, CASE WHEN row_number() OVER (PARTITION BY stop_id ORDER BY store_id) = 1 OR store_id % 10 = 0 THEN stop_id END AS credited FROM n""")
def one_credit_per_stop(spark: SparkSession, d: str) -> DataFrame:
    met = joins.range_join(i.stops(spark, d), i.stores(spark, d), [], 500.0, haversine).select("stop_id", "store_id", F.col("stop_id").alias("credited"))
    return evidence.one_credit(met, "credited", F.col("store_id") % 10 == 0, [F.col("store_id")])
