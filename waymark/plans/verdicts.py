"""Queries of verdicts on planned visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import haversine
from waymark.operators import sequence, verdicts
from waymark.plans import inputs as i
from waymark.plans.catalog import query
from waymark.sources.store import table

_FLAGS = {
    "has_gps": "k % 4 <> 0", "stale": "k % 8 = 0", "similar_plate": "k % 12 = 4", "has_tracker": "k % 16 = 4", "frozen": "k % 9 = 1", "stayed": "k % 7 = 2", "elsewhere": "c % 2 = 0", "told": "k % 5 = 3", "own_plan": "c % 3 = 0",
    "left_base": "CASE WHEN c % 4 = 1 THEN false WHEN c % 4 = 2 THEN true END", "via_geo": "k % 6 = 1", "geo_sure": "c % 5 < 3", "swapped": "k % 11 = 5", "swap_hint": "c % 13 = 0", "off_plan": "c % 17 = 0", "partial": "k % 19 = 0", "unregistered": "c % 23 = 0", "twin": "c % 29 = 0",
}
_NUMBERS = {"stops_at_store": "k % 3", "outside_at_store": "CASE WHEN c % 3 = 1 THEN 1 ELSE 0 END", "outside": "CASE WHEN c % 5 = 2 THEN 1 ELSE 0 END"}
_FACTS = "f AS (SELECT *, stops_at_store + outside_at_store + outside AS stops, stops_at_store + outside_at_store AS with_store FROM (SELECT k AS id, " + ", ".join(f"{e} AS {n}" for n, e in {**_FLAGS, **_NUMBERS}.items()) + " FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)))"
_BASE = """b AS (SELECT *, CASE WHEN NOT has_gps AND stale THEN 'stale+' WHEN NOT has_gps AND similar_plate THEN 'no_tracker+' WHEN NOT has_gps AND has_tracker THEN 'missed+' WHEN NOT has_gps THEN 'no_tracker' WHEN frozen AND stops = 0 THEN 'missed+'
  WHEN (stayed OR stops = 0) AND elsewhere AND NOT told AND own_plan THEN 'missed+' WHEN (stayed OR stops = 0) AND elsewhere AND NOT told THEN 'rerouted+' WHEN (stayed OR stops = 0) AND left_base = false THEN 'at_base' WHEN stayed OR stops = 0 THEN 'missed'
  WHEN via_geo AND outside_at_store > 0 AND geo_sure THEN 'delivered_geo' WHEN via_geo AND outside_at_store > 0 THEN 'delivered_geo+' WHEN swapped AND NOT told THEN 'rerouted+' WHEN swapped THEN 'delivered' WHEN outside > 0 AND stops_at_store = 0 THEN 'outside+' ELSE 'delivered' END AS w FROM f),
 r AS (SELECT *, replace(w, '+', '') AS s, w LIKE '%+' AS rev FROM b),
 v AS (SELECT id, CASE WHEN swap_hint AND s IN ('missed', 'no_tracker', 'at_base') THEN 'rerouted' WHEN off_plan AND s IN ('delivered', 'delivered_geo') THEN 'rerouted' ELSE s END AS status,
  (swap_hint AND s IN ('missed', 'no_tracker', 'at_base')) OR (off_plan AND s IN ('delivered', 'delivered_geo')) OR (with_store = 0 AND (partial OR unregistered OR twin)) OR rev AS review,
  CASE WHEN swap_hint AND s IN ('missed', 'no_tracker', 'at_base') THEN NULL WHEN off_plan AND s IN ('delivered', 'delivered_geo') THEN 'off_plan' WHEN with_store = 0 AND partial THEN 'partial_report' WHEN with_store = 0 AND unregistered THEN 'unregistered' WHEN with_store = 0 AND twin THEN 'ambiguous' END AS category FROM r)"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    facts = facts.select(F.col("k").alias("id"), *[F.expr(e).alias(n) for n, e in {**_FLAGS, **_NUMBERS}.items()])
    facts = facts.withColumn("stops", F.col("stops_at_store") + F.col("outside_at_store") + F.col("outside")).withColumn("with_store", F.col("stops_at_store") + F.col("outside_at_store"))
    return facts.select("id", verdicts.route_status({c: F.col(c) for c in facts.columns}).alias("v")).select("id", "v.*")


@query(f"WITH {_FACTS}, {_BASE} SELECT * FROM v")
def route_statuses(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)


@query(f"WITH {_FACTS}, {_BASE} SELECT id, CASE WHEN coalesce(category = 'partial_report', false) OR (review AND status IN ('delivered_geo', 'missed', 'at_base', 'no_tracker')) THEN 'check' WHEN status IN ('delivered', 'delivered_geo') THEN 'sure' WHEN status IN ('rerouted', 'outside', 'stale') THEN 'check' ELSE 'missed' END AS certainty FROM v")
def certainty_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select("id", verdicts.certainty(F.col("status"), F.col("review"), F.col("category")).alias("certainty"))


_NOTE = "CASE k % 9 WHEN 0 THEN 'no tracker in plan' WHEN 1 THEN 'no vehicle' WHEN 2 THEN 'waiting for the end' WHEN 3 THEN 'never left base' WHEN 4 THEN 'vehicle did not move, check' WHEN 5 THEN 'passed the address' WHEN 6 THEN 'plan plate did not pass, check' WHEN 7 THEN 'did not go' END"
_NOTES = f"n AS (SELECT o_orderkey AS id, o_custkey % 400 AS load, o_orderpriority AS net, o_orderstatus AS os, k, CASE WHEN o_custkey % 400 < 40 THEN 'plan plate did not pass, check' ELSE {_NOTE} END AS note, CASE WHEN k % 3 = 0 THEN 'delivered' WHEN k % 9 = 1 THEN 'no_tracker' WHEN k % 9 = 2 THEN 'waiting' ELSE 'missed' END AS status FROM (SELECT *, o_orderkey AS k FROM orders))"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    load = F.col("o_custkey") % 400
    status = F.expr("CASE WHEN k % 3 = 0 THEN 'delivered' WHEN k % 9 = 1 THEN 'no_tracker' WHEN k % 9 = 2 THEN 'waiting' ELSE 'missed' END")
    return o.select(F.col("k").alias("id"), load.alias("load"), F.col("o_orderpriority").alias("net"), "k", F.when(load < 40, "plan plate did not pass, check").otherwise(F.expr(_NOTE)).alias("note"), status.alias("status"))


@query(f"WITH {_NOTES} SELECT id, CASE WHEN status = 'delivered' THEN 'confirmed' WHEN note IS NULL THEN 'unconfirmed' WHEN note LIKE 'no tracker%' OR note LIKE 'no vehicle%' OR note LIKE 'waiting%' OR note LIKE 'never left base%' THEN 'without_basis' WHEN note LIKE 'vehicle did not move%' THEN 'unconfirmed' WHEN regexp_matches(note, 'review|check|passed') THEN 'review' ELSE 'unconfirmed' END AS confidence FROM n")
def confidence_labels(spark: SparkSession, d: str) -> DataFrame:
    n = _notes(spark, d)
    return n.select("id", verdicts.confidence(F.when(F.col("status") == "delivered", "confirmed").otherwise("pending"), F.col("note")).alias("confidence"))


_OUT = f"WITH {_NOTES}, w AS (SELECT load, bool_and(coalesce(starts_with(note, 'plan plate did not pass'), false)) AS whole FROM n GROUP BY load), o AS (SELECT n.*, coalesce(regexp_matches(note, '^(no vehicle|never left base|query failed|provisional plate)'), false) OR whole AS outside FROM n JOIN w USING (load))"


@query(_OUT + " SELECT id, outside FROM o")
def out_of_account(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.outside_account(_notes(spark, d), ["load"], "note").select("id", "outside")


@query(_OUT + """, q AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'delivered' WHEN k % 10 = 1 THEN 'missed' WHEN k % 10 = 2 THEN 'outdated' END AS verdict, CASE WHEN status = 'waiting' THEN 'pending' ELSE status END AS st FROM o),
 c AS (SELECT *, CASE WHEN verdict IS NOT NULL THEN verdict <> 'outdated' ELSE st = 'no_tracker' OR (NOT outside AND st <> 'pending') END AS counts FROM q)
 SELECT net, count(*) FILTER (counts) AS counted, count(*) FILTER (counts AND coalesce(verdict, st) IN ('delivered', 'no_tracker')) AS confirmed, count(verdict) AS reviewed, floor(count(*) FILTER (counts AND coalesce(verdict, st) IN ('delivered', 'no_tracker')) * 1000 / count(*) FILTER (counts) + 0.5) / 10 AS rate FROM c GROUP BY net""")
def reviewed_rate(spark: SparkSession, d: str) -> DataFrame:
    o = verdicts.outside_account(_notes(spark, d), ["load"], "note")
    o = o.withColumn("verdict", F.expr("CASE WHEN k % 10 = 0 THEN 'delivered' WHEN k % 10 = 1 THEN 'missed' WHEN k % 10 = 2 THEN 'outdated' END")).withColumn("status", F.when(F.col("status") == "waiting", "pending").otherwise(F.col("status")))
    return verdicts.rate_after_review(o, ["net"], "verdict")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'stopped ' || f || ' from the client' || CASE WHEN o_orderkey % 2 = 0 THEN ' for ' || CAST(o_custkey % 90 AS VARCHAR) || ' min' ELSE '' END WHEN 1 THEN 'signed off by the provider' WHEN 2 THEN 'one stop for several clients, ' || f || ' away'
 WHEN 3 THEN 'vehicle ' || coalesce(CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey % 150 AS VARCHAR) END, 'unknown') || ' stopped ' || f || ' from the client' WHEN 4 THEN 'came no nearer than ' || f ELSE 'no evidence' END AS reason
 FROM (SELECT *, CASE WHEN o_custkey % 5000 < 1000 THEN CAST(o_custkey % 5000 AS VARCHAR) || ' m' ELSE printf('%.1f', floor(o_custkey % 5000 / 100 + 0.5) / 10) || ' km' END AS f FROM orders)""")
def reason_sentences(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.expr("CASE o_orderkey % 7 WHEN 0 THEN 'own_ring' WHEN 1 THEN 'target_done' WHEN 2 THEN 'shared' WHEN 3 THEN 'other_vehicle' WHEN 4 THEN 'near' ELSE 'none' END")
    got = verdicts.reason(kind, (c % 5000).cast("double"), F.when(k % 2 == 0, c % 90), F.when(c % 4 != 0, c % 150))
    return table(spark, d, "orders").select(k.alias("id"), got.alias("reason"))


@query(f"WITH {i.DELIVERIES} SELECT vehicle, count(*) AS drops, count(*) FILTER (delivery % 3 <> 0) AS in_order, CAST(floor(count(*) FILTER (delivery % 3 <> 0) * 100 / count(*) + 0.5) AS BIGINT) AS percent FROM deliveries WHERE vehicle % 2 = 0 AND planned_at >= {i.T0 + 5000} GROUP BY vehicle")
def filtered_report(spark: SparkSession, d: str) -> DataFrame:
    t = i.deliveries(spark, d).withColumn("in_order", F.col("delivery") % 3 != 0)
    return verdicts.filtered_report(t, ["vehicle"], F.col("vehicle") % 2 == 0, F.col("planned_at") >= i.T0 + 5000, "in_order")


_TODAY = (i.T0 + 90000) // 86400


@query(f"""WITH {i.STOPS} SELECT stop_id FROM (SELECT *, CASE WHEN stop_id % 9 <> 0 THEN "end" END AS e FROM stops) WHERE start // 86400 >= {_TODAY} OR e IS NULL OR e // 86400 < {_TODAY}""")
def stops_that_ended(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).withColumn("end", F.when(F.col("stop_id") % 9 != 0, F.col("end")))
    return verdicts.ended_before(s, "end", F.floor(F.col("start") / 86400), F.lit(_TODAY)).select("stop_id")


@query(f"""WITH {i.STOPS}, {i.DELIVERIES}, d AS (SELECT stop_id FROM stops s JOIN deliveries r ON s.vehicle = r.vehicle AND r.planned_at BETWEEN s.start AND s."end" GROUP BY stop_id HAVING min(delivery % 5) > 1) SELECT stop_id FROM stops WHERE stop_id NOT IN (SELECT stop_id FROM d)""")
def uncontradicted_stops(spark: SparkSession, d: str) -> DataFrame:
    readings = i.deliveries(spark, d).select("vehicle", F.col("planned_at").alias("t"), (F.col("delivery") % 5).alias("speed"))
    return verdicts.uncontradicted(i.stops(spark, d), readings, "stop_id", ["vehicle"]).select("stop_id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN NULL ELSE c_name END AS body, c_custkey % 3 = 0 AND c_custkey % 2 = 0 AS unchanged FROM customer")
def unchanged_results(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"), (F.col("c_custkey") % 10).alias("mark"))
    held = c.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("mark")).otherwise(F.col("mark") + 1).alias("mark"))
    return verdicts.unchanged_dropped(c, held, ["id"], "mark", ["body"]).select("id", "body", "unchanged")


@query(f"""SELECT o_orderkey AS id, coalesce(w >= c AND c >= 88200 AND c < 106200 AND n >= 106200, false) AS retry, coalesce(w >= c AND n >= 88200 AND n < 129600, false) AS provisional, n // 86400 = 0 AND b IS NULL AS open
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 0 THEN 80000 + o_orderkey * 37 % 40000 END AS c, CASE WHEN o_orderkey % 6 <> 0 THEN 80000 + o_orderkey * 53 % 45000 END AS w, 60000 + o_orderkey * 71 % 80000 AS n, CASE WHEN o_custkey % 2 = 0 THEN 1 END AS b FROM orders)""")
def closing_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    calculated, warned, now = F.when(k % 8 != 0, 80000 + k * 37 % 40000), F.when(k % 6 != 0, 80000 + k * 53 % 45000), 60000 + k * 71 % 80000
    back = F.when(F.col("o_custkey") % 2 == 0, 1)
    day = F.lit(0)
    return table(spark, d, "orders").select(k.alias("id"), verdicts.retry_due(calculated, warned, day, now).alias("retry"), verdicts.provisional_due(calculated, warned, day, now).alias("provisional"), verdicts.day_open(day, back, F.floor(now / 86400)).alias("open"))


@query("""WITH m AS (SELECT DISTINCT c_custkey % 200 AS client, c_custkey % 7 * 100 AS due FROM customer), l AS (SELECT client, max(due) AS milestone FROM m WHERE due <= 450 GROUP BY 1)
 SELECT l.client, milestone, count(*) FILTER (due < milestone AND (due + m.client) % 3 <> 0) AS skipped FROM l JOIN m ON m.client = l.client AND due <= 450 WHERE (milestone + l.client) % 3 <> 0 GROUP BY ALL""")
def milestones_due(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "customer").select((F.col("c_custkey") % 200).alias("client"), (F.col("c_custkey") % 7 * 100).alias("at")).distinct()
    return verdicts.milestone_due(m.withColumn("done", (F.col("at") + F.col("client")) % 3 == 0), ["client"], "at", "done", F.lit(450))


@query(f"""WITH {i.DELIVERIES}, r AS (SELECT user_id AS vehicle, CAST(floor(epoch(min(ts))) AS BIGINT) AS arrival, min(floor(value)) AS low, max(floor(value)) AS high, {i.hundredths_sql('avg(floor(value))')} AS mean FROM events GROUP BY 1) SELECT delivery, r.vehicle IS NOT NULL AS visited, arrival, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, mean FROM deliveries LEFT JOIN r USING (vehicle)""")
def client_temperatures(spark: SparkSession, d: str) -> DataFrame:
    from waymark.functions.time import wall_seconds

    r = table(spark, d, "events").select(F.col("user_id").alias("vehicle"), wall_seconds(F.col("ts")).alias("t"), F.floor("value").alias("value"))
    got = verdicts.temperatures(i.deliveries(spark, d).select("delivery", "vehicle"), r, "vehicle", "value")
    return got.select("delivery", "visited", "arrival", "low", "high", i.hundredths(F.col("mean")).alias("mean"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS rows, count(DISTINCT o_custkey % 60) AS vehicles, arg_max(o_orderpriority, (o_orderkey % 100000) * 10000000 + o_orderkey) AS sender, max(o_orderkey % 100000) AS sent FROM orders GROUP BY 1")
def sent_orders_by_day(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 60).alias("vehicle"), "o_orderpriority", (F.col("o_orderkey") % 100000).alias("sent"), "o_orderkey")
    return verdicts.sent_by_day(o, "day", "vehicle", "o_orderpriority", "sent", "o_orderkey")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1995-01-01'")
def days_with_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderdate >= timestamp_ntz'1995-01-01 00:00:00'")
    return o.select(F.to_date("o_orderdate").alias("day")).distinct()


@query("SELECT p_partkey AS id, TRY_CAST(t AS BIGINT) AS value, TRY_CAST(t AS BIGINT) IS NOT NULL AS ok, CASE WHEN TRY_CAST(t AS BIGINT) IS NULL THEN 'not a number: ' || t END AS error FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS t FROM part)")
def settled_values(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("t"))
    return verdicts.settled(p, F.col("t").try_cast("long"), F.concat(F.lit("not a number: "), "t")).drop("t")


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def third_page(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.page(table(spark, d, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 50, 2).select(F.col("o_orderkey").alias("id"))


_KNOWN = "known AS (SELECT o_orderpriority AS net, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 300 END AS plate, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_custkey % 300 < 150 THEN o_custkey % 300 ELSE o_custkey % 20 END END AS code, o_custkey % 300 % 77 AS name, o_custkey % 300 % 77 * 10 AS driver, o_orderkey AS made FROM orders)"
_ASKED = "asked AS (SELECT c_custkey AS line, CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE '9-NONE' END AS net, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 500 END AS plate, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 160 END AS code, CASE WHEN c_custkey % 5 <> 1 THEN c_custkey % 90 END AS name FROM customer)"


@query(f"""WITH {_KNOWN}, {_ASKED}, one AS (SELECT net, code FROM known WHERE code IS NOT NULL GROUP BY ALL HAVING count(DISTINCT coalesce(CAST(plate AS VARCHAR), '-') || '|' || name) = 1),
 m AS (SELECT line, 0 AS p, 'plate' AS via, driver, k.plate AS plate, made FROM asked a JOIN known k ON a.net = k.net AND a.plate = k.plate UNION ALL SELECT line, 1, 'code', driver, k.plate, made FROM asked a JOIN known k ON a.net = k.net AND a.code = k.code JOIN one o ON o.net = k.net AND o.code = k.code
  UNION ALL SELECT line, 2, 'name', driver, k.plate, made FROM asked a JOIN known k ON a.net = k.net AND a.name = k.name)
 SELECT line, via, driver, plate FROM m QUALIFY row_number() OVER (PARTITION BY line ORDER BY p, made DESC) = 1""")
def priority_slots(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 300
    known = table(spark, d, "orders").select(F.col("o_orderpriority").alias("net"), F.when(k % 5 != 0, c).alias("plate"), F.when(k % 3 != 0, F.when(c < 150, c).otherwise(F.col("o_custkey") % 20)).alias("code"), (c % 77).alias("name"), (c % 77 * 10).alias("driver"), k.alias("made"))
    q = F.col("c_custkey")
    net = F.when(q % 3 == 0, "1-URGENT").when(q % 3 == 1, "5-LOW").otherwise("9-NONE")
    asked = table(spark, d, "customer").select(q.alias("line"), net.alias("net"), F.when(q % 4 == 0, q % 500).alias("plate"), F.when(q % 2 == 0, q % 160).alias("code"), F.when(q % 5 != 1, q % 90).alias("name"))
    return verdicts.priority_slot(asked, known, "line")


_RAN = """b AS (SELECT o_orderkey % 30 AS day, o_custkey % 90 AS car, o_custkey % 90 * 3 + o_orderkey % 3 AS plate, o_orderkey % 50 AS load FROM orders), s AS (SELECT l_partkey % 30 AS day, l_suppkey % 270 AS plate, CASE WHEN l_linenumber > 2 THEN l_orderkey % 50 END AS load, 300 + l_partkey % 40 AS real, l_orderkey * 10 + l_linenumber AS made FROM lineitem),
 f AS (SELECT p_partkey % 340 AS plate FROM part), t AS (SELECT s_suppkey AS load, s_suppkey % 100 AS car FROM supplier)"""


@query(f"""WITH {_RAN}, x AS (SELECT b.*, arg_max(s.real, s.made) AS real FROM b LEFT JOIN s ON s.day = b.day AND s.plate = b.plate AND (s.load IS NULL OR s.load = b.load) GROUP BY ALL), y AS (SELECT car, coalesce(real, plate) AS plate, max(day) AS day FROM x WHERE coalesce(real, plate) IN (SELECT plate FROM f) GROUP BY ALL),
 z AS (SELECT car, string_agg(CAST(plate AS VARCHAR), ',' ORDER BY day DESC, plate) AS plates FROM y GROUP BY car) SELECT load, plates FROM t JOIN z USING (car)""")
def vehicle_histories(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 90
    before = table(spark, d, "orders").select((k % 30).alias("day"), c.alias("car"), (c * 3 + k % 3).alias("plate"), (k % 50).alias("load"))
    swaps = table(spark, d, "lineitem").select((F.col("l_partkey") % 30).alias("day"), (F.col("l_suppkey") % 270).alias("plate"), F.when(F.col("l_linenumber") > 2, F.col("l_orderkey") % 50).alias("load"), (300 + F.col("l_partkey") % 40).alias("real"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("made"))
    fleet = table(spark, d, "part").select((F.col("p_partkey") % 340).alias("plate"))
    today = table(spark, d, "supplier").select(F.col("s_suppkey").alias("load"), (F.col("s_suppkey") % 100).alias("car"))
    return verdicts.vehicle_history(today, before, swaps, fleet).select("load", F.array_join(F.transform("plates", lambda p: p.cast("string")), ",").alias("plates"))


@query(f"WITH {i.ROUTES} SELECT route_id, CASE WHEN left_base > arrive THEN NULL ELSE left_base END AS left_base FROM routes")
def sane_departures(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.sane_times(i.routes(spark, d), "left_base", "arrive").select("route_id", "left_base")


_H = i.haversine_sql("lat", "lng", "lat_r", "lng_r")


@query(f"""WITH {i.STOPS}, {i.STORES}, o AS (SELECT stop_id, {_H} > 2000 AS far FROM stops JOIN stores ON store = store_id), n AS (SELECT stop_id, store_id FROM stops, stores WHERE {_H} <= 800 QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY {_H}, store_id) = 1)
 SELECT s.stop_id, coalesce(n.store_id, s.store) AS store, n.store_id IS NOT NULL AS moved FROM stops s LEFT JOIN o USING (stop_id) LEFT JOIN n ON n.stop_id = s.stop_id AND o.far""")
def codes_by_position(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.code_by_position(i.stops(spark, d), i.stores(spark, d), 2000.0, 800.0, haversine).select("stop_id", "store", "moved")


@query(f"WITH {i.STOPS}, {i.STORES} SELECT vehicle, store_id, stop_id, start FROM stops, stores WHERE kind <> 'BASE' AND {_H} <= 600 QUALIFY row_number() OVER (PARTITION BY vehicle, store_id ORDER BY start, stop_id) = 1")
def first_outside_visits(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.first_outside_visit(i.stops(spark, d), i.stores(spark, d), 600.0, haversine)


_LINES = "lines AS (SELECT c_custkey AS line, c_custkey % 40 AS store, c_custkey * 7 % 1000 AS place FROM customer)"


@query(f"""WITH {i.STOPS}, {_LINES}, a AS (SELECT line, store, row_number() OVER (PARTITION BY store ORDER BY place, line) AS n FROM lines WHERE line % 3 <> 0), b AS (SELECT stop_id, store, row_number() OVER (PARTITION BY store ORDER BY start, stop_id) AS n FROM stops WHERE store IS NOT NULL AND stop_id % 3 <> 0)
 SELECT line, stop_id, true AS "cross" FROM a JOIN b USING (store, n)""")
def last_resort_stops(spark: SparkSession, d: str) -> DataFrame:
    c, s = F.col("c_custkey"), i.stops(spark, d)
    lines = table(spark, d, "customer").select(c.alias("line"), (c % 40).alias("store"), (c * 7 % 1000).alias("place"))
    matched = lines.where("line % 3 = 0").select("line", F.lit(None).cast("long").alias("stop_id")).unionByName(s.where("stop_id % 3 = 0").select(F.lit(None).cast("long").alias("line"), "stop_id"))
    return verdicts.last_resort(lines, matched, s)


@query("""WITH p AS (SELECT l_orderkey % 500 AS line, l_partkey % 200 AS stop, l_linenumber % 3 AS score, l_linenumber = 1 AND l_orderkey % 500 % 2 = 0 AS own FROM lineitem)
 SELECT line, min(stop) AS stop FROM p WHERE score = 0 AND NOT own AND line NOT IN (SELECT line FROM p WHERE own) AND stop IN (SELECT stop FROM p WHERE own) GROUP BY line""")
def shared_exact_stops(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") % 500
    p = table(spark, d, "lineitem").select(k.alias("line"), (F.col("l_partkey") % 200).alias("stop"), (F.col("l_linenumber") % 3).alias("score"), ((F.col("l_linenumber") == 1) & (k % 2 == 0)).alias("own"))
    return verdicts.shared_exactly(p, "line", "stop", "score")


@query(f"""WITH RECURSIVE {i.STOPS}, p AS (SELECT vehicle, start // 86400 AS day, stop_id, start, "end" AS e, kind, -22.9e0 + (stop_id * 37 % 97) / 3e4 AS lat, -43.2e0 + (stop_id * 53 % 89) / 3e4 AS lng FROM stops),
 n AS (SELECT *, row_number() OVER (PARTITION BY vehicle, day ORDER BY start DESC, stop_id DESC) AS r FROM p),
 walk AS (SELECT stop_id, vehicle, day, lat, lng, r, start AS tt, true AS open, false AS grown FROM n
  UNION ALL SELECT w.stop_id, w.vehicle, w.day, w.lat, w.lng, n.r, CASE WHEN g.good THEN n.start ELSE w.tt END, g.good, w.grown OR g.good
   FROM walk w JOIN n ON n.vehicle = w.vehicle AND n.day = w.day AND n.r = w.r + 1 AND w.open, LATERAL (SELECT n.kind = 'OUTSIDE' AND n.e <= w.tt AND ((w.tt - n.e <= 600 AND n.e - n.start >= 900) OR (w.tt - n.e <= 1200 AND n.e - n.start >= 1800)) AND {i.haversine_sql('w.lat', 'w.lng', 'n.lat', 'n.lng')} <= 300 AS good) g)
 SELECT stop_id, min(tt) AS extended FROM walk WHERE grown GROUP BY stop_id""")
def backward_extensions(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).withColumn("day", F.floor(F.col("start") / 86400)).withColumn("lat", -22.9 + F.col("stop_id") * 37 % 97 / 30000).withColumn("lng", -43.2 + F.col("stop_id") * 53 % 89 / 30000)
    return sequence.chain_extend(s, ["vehicle", "day"], "stop_id", "start", "end", F.col("kind") == "OUTSIDE", backward=True).where("extended is not null").select("stop_id", "extended")
