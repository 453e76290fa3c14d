"""Queries of review operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import predicates, review
from waymark.operators.metrics import top
from waymark.plans import inputs as i
from waymark.plans.catalog import query
from waymark.sources.store import table


@query("SELECT p_partkey AS id, p_name FROM part WHERE upper(p_name) LIKE '%RED%' OR upper(p_type) LIKE '%RED%' ORDER BY p_partkey LIMIT 30")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    return review.search(table(spark, d, "part"), ["p_name", "p_type"], "réd", order=["p_partkey"]).select(F.col("p_partkey").alias("id"), "p_name")


@query(f"""WITH {i.ENTRIES}, q AS (SELECT entry, status, entry % 9 = 0 AS done, CASE WHEN entry % 9 = 0 THEN 'resolved' ELSE 'open' END AS list, CASE WHEN entry % 9 = 0 THEN 0 WHEN status = 'failed' THEN 1 WHEN status = 'undefined' THEN 2 ELSE 3 END AS category_rank FROM entries)
 SELECT entry, list, CAST(category_rank AS BIGINT) AS category_rank, CAST(row_number() OVER (PARTITION BY list, category_rank ORDER BY CASE WHEN done THEN entry % 100 END DESC NULLS LAST, entry * 7 % 1000, entry) AS INT) AS place FROM q""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    e = i.entries(spark, d).withColumn("done", F.col("entry") % 9 == 0).withColumn("at", F.col("entry") % 100)
    got = review.review_queue(e, "status", ["failed", "undefined"], [F.col("entry") * 7 % 1000], "done", "at", ["entry"])
    return got.select("entry", "list", F.col("category_rank").cast("long").alias("category_rank"), "place")


_SIM = "(1 - levenshtein(nm, nr) / CAST(greatest(length(nm), length(nr)) AS DOUBLE))"


@query(f"""WITH {i.STOPS}, {i.STORES}, m AS (SELECT stop_id, store_id, 'STORE ' || CAST(store AS VARCHAR) AS nm, 'STORE ' || CAST(store_id AS VARCHAR) AS nr, {i.haversine_sql('lat', 'lng', 'lat_r', 'lng_r')} AS d FROM stops, stores WHERE store IS NOT NULL),
 s AS (SELECT *, greatest({_SIM}, 1 - d / 800) + CASE WHEN {_SIM} >= 0.5 AND 1 - d / 800 >= 0.5 THEN 0.05e0 ELSE 0 END AS score FROM m WHERE d <= 800)
 SELECT stop_id, store_id, CAST(row_number() OVER (PARTITION BY stop_id ORDER BY score DESC, d, nr) AS INT) AS place FROM s WHERE score >= 0.5 QUALIFY place <= 5""")
def store_suggestions(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).where("store is not null").withColumn("nm", F.concat(F.lit("Store "), "store"))
    t = i.stores(spark, d).withColumn("nr", F.concat(F.lit("STORE "), "store_id"))
    return review.suggestions(s, t, ["stop_id"], "nm", "nr", 800.0).select("stop_id", "store_id", "place")


@query("""SELECT p_partkey AS id, least(1.0e0, 0.5e0 + 0.1e0 * CASE WHEN p_partkey % 3 = 0 THEN n ELSE 0 END) AS confidence, p_size % 5 + CASE WHEN p_partkey % 3 = 0 THEN n ELSE 0 END AS votes, p_size % 5 + CASE WHEN p_partkey % 3 = 0 THEN n ELSE 0 END >= 5 AS automatic,
 CAST(1 + CASE WHEN p_partkey % 3 = 0 AND n > 0 THEN 1 ELSE 0 END AS BIGINT) AS version FROM (SELECT p_partkey, p_size, (SELECT count(*) FROM supplier WHERE s_suppkey % 40 = p_partkey % 40) AS n FROM part)""")
def alias_approvals(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).alias("m"), F.lit(0.5).alias("confidence"), (F.col("p_size") % 5).cast("long").alias("votes"), F.lit(1).cast("long").alias("version"))
    votes = a.join(table(spark, d, "supplier").select((F.col("s_suppkey") % 40).alias("m")), "m").select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(9).cast("long").alias("version"))
    return review.approved(a.drop("m"), votes, ["id"])


@query("""WITH c AS (SELECT o_orderkey % 2500 AS k, o_orderkey AS made, o_custkey AS v FROM orders), l AS (SELECT k, v FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY made DESC) = 1)
 SELECT coalesce(p.p_partkey, l.k) AS k, coalesce(l.v, CAST(p.p_size AS BIGINT)) AS v, p.p_partkey IS NULL AS added FROM part p FULL JOIN l ON p.p_partkey = l.k""")
def changed_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("v"))
    changes = table(spark, d, "orders").select((F.col("o_orderkey") % 2500).alias("k"), F.col("o_orderkey").alias("made"), F.col("o_custkey").alias("v"))
    return review.changed_plan(plan, changes, ["k"], "v", ["made"])


@query(f"""WITH {i.STOPS}, {i.DELIVERIES}, a AS (SELECT vehicle, delivery, row_number() OVER w AS r, count(*) OVER (PARTITION BY vehicle) AS n FROM deliveries WINDOW w AS (PARTITION BY vehicle ORDER BY planned_at, delivery)),
 b AS (SELECT vehicle, stop_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY vehicle) AS n FROM stops WHERE store < 7 WINDOW w AS (PARTITION BY vehicle ORDER BY start, stop_id)) SELECT delivery, stop_id FROM a JOIN b ON a.vehicle = b.vehicle AND a.r = b.r AND a.n = b.n""")
def chronological_pairs(spark: SparkSession, d: str) -> DataFrame:
    left = i.deliveries(spark, d).select("vehicle", "delivery", "planned_at")
    right = i.stops(spark, d).where("store < 7").select("vehicle", "stop_id", "start")
    return review.paired_in_order(left, right, ["vehicle"], ["planned_at", "delivery"], ["start", "stop_id"]).select("delivery", "stop_id")


@query(f"""WITH {i.STOPS}, {i.DELIVERIES}, m AS (SELECT delivery, stop_id, {i.haversine_sql('p.lat', 'p.lng', 's.lat', 's.lng')} AS d FROM deliveries p JOIN stops s USING (vehicle) WHERE planned_at BETWEEN start - 600 AND "end" + 600)
 SELECT delivery, stop_id FROM m WHERE d <= 2500 QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY d, stop_id) = 1""")
def sign_off_near_stop(spark: SparkSession, d: str) -> DataFrame:
    done = i.deliveries(spark, d).withColumnRenamed("planned_at", "t")
    stops = i.stops(spark, d).select("vehicle", "stop_id", "start", "end", F.col("lat").alias("lat_r"), F.col("lng").alias("lng_r"))
    return review.near_in_time_and_space(done, stops, ["vehicle"], ["delivery"], 600, 2500.0).select("delivery", "stop_id")


@query(f"WITH {i.ENTRIES} SELECT store, count(DISTINCT CASE WHEN status = 'failed' THEN day END) AS failed_days, count(DISTINCT day) AS days FROM entries GROUP BY store HAVING count(DISTINCT CASE WHEN status = 'failed' THEN day END) >= 5")
def failing_clients(spark: SparkSession, d: str) -> DataFrame:
    return review.failing_clients(i.entries(spark, d), "store", "day", F.col("status") == "failed", 5)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipmode AS code FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'source_down' WHEN 'R' THEN 'partial' ELSE 'no_plan' END AS l_shipmode FROM lineitem) WHERE l_returnflag = 'N' OR (l_returnflag = 'A' AND l_linestatus <> 'F') OR (l_returnflag = 'R' AND l_discount > 0.05)")
def publication_gate(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("l_returnflag") == "A", "source_down").when(F.col("l_returnflag") == "R", "partial").otherwise("no_plan")
    w = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", code.alias("code"), F.col("l_linestatus").alias("source"), F.col("l_discount").alias("share"))
    return predicates.blocking(w, ["no_plan"], "source_down", "F", "partial", 0.05).drop("source", "share")


@query(f"WITH {i.STOPS} SELECT vehicle, stop_id, \"end\" - start AS dwell FROM stops WHERE kind IN ('OUTSIDE', 'FAKE_EXIT') AND \"end\" - start >= 600 ORDER BY dwell DESC, stop_id LIMIT 60")
def risk_stops(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).where(F.col("kind").isin("OUTSIDE", "FAKE_EXIT")).withColumn("dwell", F.col("end") - F.col("start"))
    return top(s.where("dwell >= 600").select("vehicle", "stop_id", "dwell"), [F.col("dwell").desc(), F.col("stop_id")], 60)
