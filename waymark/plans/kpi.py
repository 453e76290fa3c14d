"""Queries of aggregations, rankings and periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import time as clock
from waymark.functions.text import group_key
from waymark.operators import metrics
from waymark.plans import inputs as i
from waymark.plans.catalog import query
from waymark.sources.store import table

_E = f"WITH {i.ENTRIES}"
_M = "CASE WHEN {0} IS NULL OR {0} = '-' THEN NULL ELSE CAST(substr({0}, 1, 2) AS INT) * 60 + CAST(substr({0}, 4, 2) AS INT) END"


def _gap(a: str, b: str) -> str:
    return f"(({_M.format(b)}) - ({_M.format(a)}) + 1440) % 1440"


_T = _E + f", t AS (SELECT *, {_gap('left_base', 'arrive')} AS route, {_gap('arrive', 'leave')} AS dwell, {_gap('left_base', 'leave')} AS total, {_gap('left_base', 'back')} AS operation, {_gap('leave', 'back')} AS way_back FROM entries)"
_MEAN = "CAST(floor(avg(CASE WHEN status = 'delivered' THEN {0} END) + 0.5) AS BIGINT)"
_RATE = "CAST(coalesce(floor(100e0 * count(*) FILTER (status = 'delivered') / nullif(count(*) FILTER (status IN ('delivered', 'failed')), 0) + 0.5), 0) AS BIGINT)"


def _status(name: str):
    return F.col("status") == name


def _times(spark: SparkSession, d: str) -> DataFrame:
    e = i.entries(spark, d)
    gap = lambda a, b: clock.clock_gap(F.col(a), F.col(b))
    return e.select("*", gap("left_base", "arrive").alias("route"), gap("arrive", "leave").alias("dwell"), gap("left_base", "leave").alias("total"), gap("left_base", "back").alias("operation"), gap("leave", "back").alias("way_back"))


def _mean(c: str):
    return metrics.mean_minutes(F.col(c), _status("delivered"))


@query(_E + f" SELECT network, count(*) AS total, count(*) FILTER (status = 'delivered') AS done, count(*) FILTER (status = 'failed') AS failed, {_RATE} AS rate FROM entries GROUP BY network")
def definitive_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.definitive_rate(i.entries(spark, d), ["network"], _status("delivered"), _status("failed"))


@query(_T + f" SELECT count(*) AS total, count(*) FILTER (status = 'no_tracker') AS no_tracker, count(DISTINCT CASE WHEN status = 'delivered' THEN vehicle END) AS plates, {_MEAN.format('route')} AS route, {_MEAN.format('total')} AS total_min, {_MEAN.format('operation')} AS operation, {_MEAN.format('way_back')} AS way_back, CAST(floor(100e0 * count(*) FILTER (status = 'delivered' AND back IS NOT NULL) / count(*) FILTER (status = 'delivered') + 0.5) AS BIGINT) AS with_return FROM t")
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    done = _status("delivered")
    return _times(spark, d).agg(F.count("*").alias("total"), F.count_if(_status("no_tracker")).alias("no_tracker"), F.countDistinct(F.when(done, F.col("vehicle"))).alias("plates"), _mean("route").alias("route"), _mean("total").alias("total_min"), _mean("operation").alias("operation"), _mean("way_back").alias("way_back"), metrics.percent(F.count_if(done & F.col("back").isNotNull()), F.count_if(done)).alias("with_return"))


@query(_T + f" SELECT network, count(*) AS entries, count(DISTINCT store) AS stores, {_MEAN.format('route')} AS route, {_MEAN.format('dwell')} AS dwell, {_MEAN.format('total')} AS total, {_MEAN.format('operation')} AS operation, count(*) FILTER (status = 'no_tracker') AS no_tracker FROM t GROUP BY network")
def client_times(spark: SparkSession, d: str) -> DataFrame:
    return _times(spark, d).groupBy("network").agg(F.count("*").alias("entries"), F.countDistinct("store").alias("stores"), *[_mean(c).alias(c) for c in ("route", "dwell", "total", "operation")], F.count_if(_status("no_tracker")).alias("no_tracker"))


@query(_E + " SELECT day, count(*) AS total, count(*) FILTER (status = 'delivered') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'no_tracker') AS no_tracker FROM entries GROUP BY day")
def daily_series(spark: SparkSession, d: str) -> DataFrame:
    return i.entries(spark, d).groupBy("day").agg(F.count("*").alias("total"), *[F.count_if(_status(s)).alias(a) for s, a in (("delivered", "done"), ("failed", "failed"), ("no_tracker", "no_tracker"))])


@query(_T + f" SELECT day, {_MEAN.format('route')} AS route, {_MEAN.format('dwell')} AS dwell, {_MEAN.format('total')} AS total, {_MEAN.format('operation')} AS operation FROM t WHERE status = 'delivered' GROUP BY day")
def time_series(spark: SparkSession, d: str) -> DataFrame:
    return _times(spark, d).where(_status("delivered")).groupBy("day").agg(*[_mean(c).alias(c) for c in ("route", "dwell", "total", "operation")])


@query(_E + ", c AS (SELECT day, network, CAST(floor(100e0 * count(*) FILTER (status = 'delivered') / count(*) + 0.5) AS BIGINT) AS pct FROM entries GROUP BY ALL) SELECT d.day, n.network, c.pct FROM (SELECT DISTINCT day FROM entries) d CROSS JOIN (SELECT DISTINCT network FROM entries) n LEFT JOIN c ON c.day = d.day AND c.network = n.network")
def day_network_matrix(spark: SparkSession, d: str) -> DataFrame:
    e = i.entries(spark, d)
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]  # fixed values of the column; a pivot needs them
    wide = e.groupBy("day").pivot("network", names).agg(metrics.percent(F.count_if(_status("delivered")), F.count(F.lit(1))))
    return wide.unpivot(["day"], names, "network", "pct")


@query(_E + ", s AS (SELECT network, store, count(*) AS n FROM entries WHERE status = 'failed' GROUP BY ALL) SELECT * FROM s ORDER BY n DESC, network, store LIMIT 20")
def top_failing_stores(spark: SparkSession, d: str) -> DataFrame:
    got = i.entries(spark, d).where(_status("failed")).groupBy("network", "store").agg(F.count("*").alias("n"))
    return metrics.top(got, [F.col("n").desc(), F.col("network"), F.col("store")], 20)


@query(_T + ", s AS (SELECT network, store, greatest(count(route), count(dwell)) AS n, CAST(floor(avg(route) + 0.5) AS BIGINT) AS route, CAST(floor(avg(dwell) + 0.5) AS BIGINT) AS dwell, CAST(floor(avg(total) + 0.5) AS BIGINT) AS total FROM t WHERE status = 'delivered' GROUP BY ALL HAVING count(route) >= 2 OR count(dwell) >= 2) SELECT * FROM s WHERE route IS NOT NULL ORDER BY route DESC, network, store LIMIT 15")
def slowest_routes(spark: SparkSession, d: str) -> DataFrame:
    means = [clock.rounded(F.avg(c)).alias(c) for c in ("route", "dwell", "total")]
    got = _times(spark, d).where(_status("delivered")).groupBy("network", "store").agg(F.count("route").alias("_r"), F.count("dwell").alias("_d"), *means)
    got = got.where("_r >= 2 or _d >= 2").where("route is not null").select("network", "store", F.greatest("_r", "_d").alias("n"), "route", "dwell", "total")
    return metrics.top(got, [F.col("route").desc(), F.col("network"), F.col("store")], 15)


@query(_T + f" SELECT driver, count(*) AS n, {_MEAN.format('route')} AS route FROM t WHERE status = 'delivered' GROUP BY driver ORDER BY n DESC, driver LIMIT 15")
def top_drivers(spark: SparkSession, d: str) -> DataFrame:
    got = _times(spark, d).where(_status("delivered")).groupBy("driver").agg(F.count("*").alias("n"), _mean("route").alias("route"))
    return metrics.top(got, [F.col("n").desc(), F.col("driver")], 15)


@query(_E + " SELECT h AS hour, count(entry) AS n FROM range(24) r(h) LEFT JOIN entries ON left_base <> '-' AND CAST(substr(left_base, 1, 2) AS INT) = h GROUP BY h")
def departure_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dense_histogram(i.entries(spark, d), F.floor(clock.clock_minutes(F.col("left_base")) / 60), 24, "hour")


@query(_E + ", s AS (SELECT CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END AS shift FROM (SELECT CAST(substr(arrive, 1, 2) AS INT) AS h FROM entries)) SELECT shift, count(*) AS n FROM s GROUP BY shift")
def shift_counts(spark: SparkSession, d: str) -> DataFrame:
    return i.entries(spark, d).groupBy(clock.shift_of(F.col("arrive")).alias("shift")).agg(F.count("*").alias("n"))


@query(_E + f", r AS (SELECT driver, day, {_RATE} AS rate FROM entries WHERE status IN ('delivered', 'failed') GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY day DESC) AS r FROM r) SELECT driver, count(*) FILTER (rate < 60) AS below, count(*) AS days FROM l WHERE r <= 5 GROUP BY driver HAVING count(*) FILTER (rate < 60) >= 3")
def worst_recurring_drivers(spark: SparkSession, d: str) -> DataFrame:
    e = i.entries(spark, d).where(F.col("status").isin("delivered", "failed"))
    return metrics.worst_recurring(metrics.definitive_rate(e, ["driver", "day"], _status("delivered"), _status("failed")), ["driver"], "day", "rate", 60)


@query("WITH n AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name ELSE '  ' || replace(p_name, 'e', 'é') END AS name, p_retailprice AS v FROM part), k AS (SELECT *, lower(replace(trim(name), 'é', 'e')) AS key FROM n), s AS (SELECT key, name, count(*) AS c FROM k GROUP BY ALL) SELECT key, count(*) AS n, (SELECT name FROM s WHERE s.key = k.key ORDER BY c DESC, name LIMIT 1) AS shown FROM k GROUP BY key")
def folded_groups(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("  "), F.replace("p_name", F.lit("e"), F.lit("é")))).alias("name"))
    return metrics.by_folded_name(p, "name", group_key(F.col("name")), [F.count("*").alias("n")])


@query(_E + " SELECT vehicle, day FROM entries GROUP BY ALL HAVING bool_and(status = 'failed')")
def fully_failed_loads(spark: SparkSession, d: str) -> DataFrame:
    return metrics.all_rows(i.entries(spark, d), ["vehicle", "day"], _status("failed"))


@query(_E + ", s AS (SELECT network, count(*) AS total, count(*) FILTER (status = 'delivered') AS done, avg(store) AS mean_store FROM entries GROUP BY network) SELECT network, metric, value FROM (SELECT network, CAST(total AS DOUBLE) AS total, CAST(done AS DOUBLE) AS done, mean_store FROM s) UNPIVOT (value FOR metric IN (total, done, mean_store))")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    got = i.entries(spark, d).groupBy("network").agg(F.count("*").alias("total"), F.count_if(_status("delivered")).alias("done"), F.avg("store").alias("mean_store"))
    return metrics.melted(got, ["network"])


@query(f"WITH {i.STOPS}, p AS (SELECT store AS k, lat, lng FROM stops WHERE store IS NOT NULL), m AS (SELECT k, quantile_cont(lat, 0.5) AS a, quantile_cont(lng, 0.5) AS b FROM p GROUP BY k) SELECT k AS store, floor(quantile_cont(lat, 0.5) * 1e6 + 0.5) / 1e6 AS lat, floor(quantile_cont(lng, 0.5) * 1e6 + 0.5) / 1e6 AS lng, count(*) AS n FROM p JOIN m USING (k) WHERE {i.haversine_sql('lat', 'lng', 'a', 'b')} <= 3000 GROUP BY k")
def consensus_points(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.consensus_points(i.stops(spark, d).where("store is not null"), ["store"], 3000.0)
    return got.select("store", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("lat", "lng")], "n")


@query(_T + ", e AS (SELECT network, CAST(abs(route - 90) AS DOUBLE) AS e FROM t) SELECT network, count(*) AS n, count(e) AS found, quantile_cont(e, 0.5) AS median, quantile_disc(e, 0.9) AS p90, CAST(floor(100e0 * count(*) FILTER (e <= 10) / count(e) + 0.5) AS BIGINT) AS within FROM e GROUP BY network")
def golden_set_errors(spark: SparkSession, d: str) -> DataFrame:
    return metrics.error_figures(_times(spark, d), ["network"], (F.col("route") - 90).cast("double"), 10)


@query(f"WITH {i.STOPS}, s AS (SELECT start % 86400 // 900 AS slot, vehicle, count(*) AS t, count(*) FILTER (\"end\" - start > 900) AS l FROM stops GROUP BY ALL) SELECT slot, count(*) AS keys, count(*) FILTER (l = t) AS all_late FROM s GROUP BY slot HAVING 100 * count(*) FILTER (l = t) >= 50 * count(*)")
def collector_outages(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).groupBy(F.floor(F.col("start") % 86400 / 900).alias("slot"), "vehicle").agg(F.count("*").alias("t"), F.count_if(F.col("end") - F.col("start") > 900).alias("l"))
    return metrics.slot_outages(s, "slot", "vehicle", "t", "l")[0]


@query(f"WITH {i.STOPS}, s AS (SELECT vehicle, count(*) AS total, count(*) FILTER (\"end\" - start > 1500) AS late FROM stops GROUP BY vehicle) SELECT * FROM s WHERE 100 * late > 30 * total")
def faulty_trackers(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).groupBy(F.floor(F.col("start") % 86400 / 900).alias("slot"), "vehicle").agg(F.count("*").alias("t"), F.count_if(F.col("end") - F.col("start") > 1500).alias("l"))
    return metrics.slot_outages(s, "slot", "vehicle", "t", "l")[1]


@query(f"WITH {i.STOPS}, s AS (SELECT vehicle, bool_and(\"end\" - start < 7200) AS f FROM stops GROUP BY vehicle) SELECT vehicle FROM s WHERE f AND ((SELECT count(*) FROM s) < 10 OR 100 * (SELECT count(*) FILTER (f) FROM s) <= 25 * (SELECT count(*) FROM s))")
def signal_loss_guard(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).groupBy("vehicle").agg(F.bool_and(F.col("end") - F.col("start") < 7200).alias("f"))
    return metrics.guarded(s, F.col("f"), 25, 10).select("vehicle")


@query(_E + " SELECT driver, count(DISTINCT vehicle) AS partners FROM entries GROUP BY driver HAVING count(DISTINCT vehicle) >= 2")
def drivers_with_many_plates(spark: SparkSession, d: str) -> DataFrame:
    return metrics.many_partners(i.entries(spark, d), "driver", "vehicle")


@query(f"WITH {i.DELIVERIES}, p AS (SELECT DISTINCT vehicle, lat, lng FROM deliveries), m AS (SELECT a.vehicle, max({i.haversine_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')}) AS m FROM p a JOIN p b USING (vehicle) GROUP BY 1) SELECT vehicle, {i.hundredths_sql('m')} AS diameter_m FROM m WHERE m > 9000")
def spread_loads(spark: SparkSession, d: str) -> DataFrame:
    return metrics.spread(i.deliveries(spark, d), ["vehicle"], 9000.0).withColumn("diameter_m", i.hundredths(F.col("diameter_m")))


@query(_E + ", d AS (SELECT day, count(*) AS n, count(*) FILTER (status = 'delivered') AS done FROM entries GROUP BY day) SELECT count(*) AS days, count(*) FILTER (n >= 5) AS complete, CAST(sum(CASE WHEN n >= 5 THEN n END) AS BIGINT) AS n, CAST(sum(CASE WHEN n >= 5 THEN done END) AS BIGINT) AS done FROM d")
def period_totals(spark: SparkSession, d: str) -> DataFrame:
    days = i.entries(spark, d).groupBy("day").agg(F.count("*").alias("n"), F.count_if(_status("delivered")).alias("done"))
    return metrics.partial_day_totals(days, F.col("n") < 5, ["n", "done"])


@query(_E + " SELECT network, status AS reason, count(*) AS n FROM entries GROUP BY ALL")
def reason_sums(spark: SparkSession, d: str) -> DataFrame:
    maps = i.entries(spark, d).groupBy("network", "day").agg(F.count_if(_status("delivered")).alias("a"), F.count_if(_status("failed")).alias("b"), F.count_if(_status("no_tracker")).alias("c"), F.count_if(_status("undefined")).alias("e"))
    maps = maps.select("network", F.map_filter(F.create_map(F.lit("delivered"), "a", F.lit("failed"), "b", F.lit("no_tracker"), "c", F.lit("undefined"), "e"), lambda k, v: v > 0).alias("reasons"))
    return metrics.map_sums(maps, ["network"], "reasons")


@query(_E + " SELECT driver, count(*) AS n, count(*) FILTER (status = 'undefined') AS flagged FROM entries GROUP BY driver HAVING 100 * count(*) FILTER (status = 'undefined') > 22 * count(*)")
def share_alerts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.share_alert(i.entries(spark, d), ["driver"], _status("undefined"), 22)


@query("SELECT o_orderpriority AS network, o_orderstatus AS status, count(*) AS n, CAST(floor(sum(o_totalprice) + 0.5) AS BIGINT) AS price FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())")
def several_grains(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("network"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return o.rollup("network", "status").agg(F.count("*").alias("n"), clock.rounded(F.sum("o_totalprice")).alias("price"))


@query(_E + f", a AS (SELECT CASE WHEN day >= DATE '1998-01-01' THEN 'now' ELSE 'before' END AS period, * FROM entries WHERE day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31') SELECT network, {_RATE.replace('count(*)', 'count(*)').replace('(status', chr(40) + 'period = ' + chr(39) + 'now' + chr(39) + ' AND status')} AS rate_now, {_RATE.replace('(status', chr(40) + 'period = ' + chr(39) + 'before' + chr(39) + ' AND status')} AS rate_before FROM a GROUP BY network")
def period_comparison(spark: SparkSession, d: str) -> DataFrame:
    e = i.entries(spark, d)
    year = lambda y: metrics.definitive_rate(e.where(F.year("day") == y), ["network"], _status("delivered"), _status("failed"))
    return year(1998).select("network", F.col("rate").alias("rate_now")).join(year(1997).select("network", F.col("rate").alias("rate_before")), "network")


@query(f"""SELECT store, count(*) AS orders, count(DISTINCT o_custkey) AS customers, floor(avg(o_totalprice) FILTER (o_orderstatus = 'F') + 0.5) AS mean_f, quantile_cont(o_totalprice, 0.5) AS median, mode(h) AS hour FROM (SELECT *, o_custkey % 40 AS store, o_custkey % 40 + 0 * o_orderkey AS h FROM orders) GROUP BY store""")
def store_analytics(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("store", F.col("o_custkey") % 40)
    return o.groupBy("store").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), clock.rounded(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))).cast("double").alias("mean_f"), F.percentile("o_totalprice", 0.5).alias("median"), F.mode("store", True).alias("hour"))


@query(_E + ", v AS (SELECT vehicle, count(*) FILTER (status = 'delivered') AS ok, count(*) FILTER (status = 'failed') AS bad FROM entries GROUP BY vehicle) SELECT vehicle, CASE WHEN ok + bad > 0 THEN 0 ELSE 1 END AS grp, bad, row_number() OVER (ORDER BY CASE WHEN ok + bad > 0 THEN 0 ELSE 1 END, ok / nullif(CAST(ok + bad AS DOUBLE), 0), bad DESC, vehicle) AS place FROM v ORDER BY place LIMIT 50")
def worst_first(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    v = i.entries(spark, d).groupBy("vehicle").agg(F.count_if(_status("delivered")).alias("ok"), F.count_if(_status("failed")).alias("bad"))
    v = v.withColumn("grp", F.when(F.col("ok") + F.col("bad") > 0, 0).otherwise(1)).withColumn("_rate", F.try_divide("ok", F.col("ok") + F.col("bad")))
    order = [F.col("grp"), F.col("_rate"), F.col("bad").desc(), F.col("vehicle")]
    first = metrics.top(v, order, 50)  # numbered after the cut, so the one partition holds 50 rows
    return first.select("vehicle", "grp", "bad", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))
