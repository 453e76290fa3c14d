"""Queries of anomaly rules and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import anomalies, rowsets
from waymark.plans import inputs as i
from waymark.plans.catalog import query
from waymark.sources.store import table

_R = f"WITH {i.ROUTES}, {i.STOPS}, {i.STORES}"


def _sel(code: str, subject: str, detail: str = "''") -> str:
    return f"SELECT 'ANOM-{code}' AS code, '{anomalies.SEVERITY[code]}' AS severity, CAST({subject} AS VARCHAR) AS subject, coalesce(CAST({detail} AS VARCHAR), '') AS detail"


@query(f"{_R} {_sel('01', 'route_id', chr(67) + 'ASE WHEN g.vehicle IS NULL THEN ' + chr(39) + 'no stops' + chr(39) + ' ELSE ' + chr(39) + 'no match' + chr(39) + ' END')} FROM routes r LEFT JOIN (SELECT DISTINCT vehicle FROM stops) g ON g.vehicle = r.vehicle WHERE g.vehicle IS NULL OR arrive IS NULL")
def anomaly_01(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.unmatched_plan(i.routes(spark, d), i.stops(spark, d))


@query(f"{_R} {_sel('02', 'vehicle')} FROM (SELECT DISTINCT vehicle FROM stops WHERE vehicle NOT IN (SELECT vehicle FROM routes))")
def anomaly_02(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.unplanned(i.routes(spark, d), i.stops(spark, d))


@query(f"{_R} {_sel('03', 'stop_id')} FROM stops WHERE kind = 'OUTSIDE' AND store IS NULL AND \"end\" - start >= 600")
def anomaly_03(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.outside_without_store(i.stops(spark, d))


@query(f"{_R} {_sel('04', 'route_id')} FROM routes WHERE leave < arrive UNION ALL {_sel('12', 'route_id')} FROM routes WHERE leave = arrive")
def anomaly_04_12(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.bad_times(i.routes(spark, d))


@query(f"{_R}, n AS (SELECT vehicle, day, count(arrive) AS n FROM routes GROUP BY ALL) {_sel('05', 'route_id', 'n')} FROM routes JOIN n USING (vehicle, day) WHERE n <> 1 AND NOT regexp_matches(label, '[+/]')")
def anomaly_05(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.wrong_stop_count(i.routes(spark, d), ["vehicle", "day"])


@query(f"{_R} {_sel('06', 'route_id')} FROM routes WHERE arrive IS NOT NULL AND left_base IS NULL UNION ALL {_sel('07', 'route_id')} FROM routes WHERE arrive < left_base")
def anomaly_06_07(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.departures(i.routes(spark, d))


@query(f"{_R} {_sel('08', 'route_id', 'CAST(floor((leave - arrive) / 60e0) AS BIGINT)')} FROM routes WHERE leave - arrive > 14400")
def anomaly_08(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.long_stay(i.routes(spark, d))


@query(f"{_R} {_sel('10', 'route_id')} FROM routes WHERE store IS NULL AND regexp_matches(label, 'STORE 1')")
def anomaly_10(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.unresolved_store(i.routes(spark, d), "STORE 1")


@query(f"{_R} {_sel('11', 'route_id', 'left_base % 86400 // 60')} FROM routes WHERE NOT (left_base % 86400 // 60 >= 1320 OR left_base % 86400 // 60 <= 600)")
def anomaly_11(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.odd_departure(i.routes(spark, d), 1320, 600)


@query(f"{_R} {_sel('13', 'route_id', 'CAST(dist_m AS BIGINT)')} FROM routes WHERE dist_m > 2000")
def anomaly_13(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.far_credit(i.routes(spark, d))


@query(f"{_R}, l AS (SELECT *, lag(\"end\") OVER w AS pe, lag(store) OVER w AS ps FROM stops WHERE kind = 'STORE' WINDOW w AS (PARTITION BY vehicle ORDER BY start, stop_id)) {_sel('14', 'stop_id', 'ps')} FROM l WHERE start < pe - 60 AND store <> ps")
def anomaly_14(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.two_places_at_once(i.stops(spark, d), ["vehicle"])


@query(f"WITH p AS (SELECT DISTINCT {i.plate_sql('c_custkey')} AS plate FROM customer), s AS (SELECT DISTINCT {i.plate_sql('s_suppkey * 7 + 3')} AS other FROM supplier) {_sel('15', 'plate', 'min(other)')} FROM p JOIN s ON hamming(plate, other) = 1 WHERE plate NOT IN (SELECT other FROM s) GROUP BY plate")
def anomaly_15(spark: SparkSession, d: str) -> DataFrame:
    planned = table(spark, d, "customer").select(i.plate_of("c_custkey").alias("plate"))
    seen = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey") * 7 + 3).select(i.plate_of("k").alias("plate"))
    return anomalies.near_plates(planned, seen, "plate")


@query(f"{_R}, g AS (SELECT vehicle, start // 86400 AS day, count(*) FILTER (kind IN ('STORE', 'OUTSIDE')) AS n, max(start % 86400) AS last FROM stops GROUP BY ALL) {_sel('16', 'vehicle', 'n')} FROM g WHERE n <= 1 AND last < 18000")
def anomaly_16(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.hardly_moved(i.stops(spark, d).withColumn("day", F.floor(F.col("start") / 86400)), ["vehicle", "day"])


@query(f"{_R}, m AS (SELECT stop_id, store_id FROM (SELECT stop_id, store_id, {i.haversine_sql('lat', 'lng', 'lat_r', 'lng_r')} AS d FROM stops, stores WHERE kind = 'FAKE_EXIT') WHERE d <= 80 QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY d, store_id) = 1) {_sel('17', 'stop_id', 'store_id')} FROM m")
def anomaly_17(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.hidden_stop(i.stops(spark, d), i.stores(spark, d), [])


@query(f"""{_R}, f AS (SELECT 'ANOM-08' AS code, false AS h, route_id FROM routes WHERE leave - arrive > 14400 UNION ALL SELECT 'ANOM-07', true, route_id FROM routes WHERE arrive < left_base UNION ALL SELECT 'ANOM-13', false, route_id FROM routes WHERE dist_m > 2000 UNION ALL SELECT 'ANOM-06', true, route_id FROM routes WHERE arrive IS NOT NULL AND left_base IS NULL)
 SELECT CAST(route_id AS VARCHAR) AS subject, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, bool_or(h) AS high, string_agg(DISTINCT CASE code WHEN 'ANOM-08' THEN 'stayed long' ELSE code END, '; ' ORDER BY CASE code WHEN 'ANOM-08' THEN 'stayed long' ELSE code END) AS text FROM f GROUP BY route_id""")
def described_anomalies(spark: SparkSession, d: str) -> DataFrame:
    r = i.routes(spark, d)
    found = anomalies.collected(anomalies.long_stay(r), anomalies.departures(r), anomalies.far_credit(r))
    got = anomalies.described(found, {"ANOM-08": "stayed long"})
    return got.withColumn("text", F.array_join(F.array_sort(F.split("text", "; ")), "; "))


@query("SELECT count(*) AS rows, count(DISTINCT (user_id, event_type)) AS distinct_rows FROM events")
def exact_repeats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type")
    return e.agg(F.count("*").alias("rows"), F.countDistinct("user_id", "event_type").alias("distinct_rows"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_orderkey AS VARCHAR) || CASE WHEN r = 1 THEN '' ELSE '-' || CAST(r AS VARCHAR) END AS nf FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem)")
def numbered_repeats(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return rowsets.numbered_repeats(table(spark, d, "lineitem"), "l_orderkey", order, "nf").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "nf")


@query("SELECT o_custkey % 100 AS load, count(*) AS lost FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1")
def shrunken_loads(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("nf"), (F.col("o_custkey") % 100).alias("load"))
    new = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("nf"))
    return rowsets.shrunken(old, new, "load", "nf")


@query(f"WITH {i.DELIVERIES} SELECT lat, lng, count(DISTINCT client) AS n_keys FROM deliveries GROUP BY ALL HAVING count(DISTINCT client) > 1")
def colliding_points(spark: SparkSession, d: str) -> DataFrame:
    return rowsets.colliding(i.deliveries(spark, d), ["lat", "lng"], "client")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS v FROM orders WHERE o_orderkey % 3 <> 1) b ON a.k = b.k")
def merged_versions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey").alias("k")
    old = o.where("o_orderkey % 3 <> 0").select(k, F.col("o_orderstatus").alias("v"))
    return rowsets.merged(old, o.where("o_orderkey % 3 <> 1").select(k, F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("v")), ["k"])


@query(f"WITH {i.STOPS} SELECT stop_id FROM stops WHERE CASE WHEN vehicle % 5 = 0 AND vehicle IN (SELECT vehicle FROM stops WHERE stop_id % 7 = 0) THEN stop_id % 7 = 0 ELSE stop_id % 7 <> 0 END")
def arbitrated_sources(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d)
    return rowsets.arbitrated(s.where("stop_id % 7 <> 0"), s.where("stop_id % 7 = 0"), ["vehicle"], s.where("vehicle % 5 = 0")).select("stop_id")


@query("SELECT k, version, usable OR published AS official FROM (SELECT o_custkey AS k, o_orderkey AS version, o_orderstatus = 'F' AS usable, o_orderpriority = '1-URGENT' AS published, o_orderdate AS created FROM orders) QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN usable THEN 1 WHEN published THEN 2 ELSE 3 END, created DESC, version DESC) = 1")
def official_versions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"), (F.col("o_orderstatus") == "F").alias("usable"), (F.col("o_orderpriority") == "1-URGENT").alias("published"), F.struct("o_orderdate", "o_orderkey").alias("created"))
    return rowsets.principal_versions(o, ["k"]).select("k", "version", "official")
