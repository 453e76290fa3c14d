"""Stand-in tables of the domain, derived alike in Spark and in SQL from the driver's tables.

Times are wall-clock seconds. A vehicle is a user of ``events``; stops follow each other every
half hour or so; points come from exact arithmetic on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.time import wall_seconds
from waymark.sources.store import table

T0 = 1704067200
BOX = (-23.5, -22.0, -44.0, -42.5)


def stops(spark: SparkSession, d: str) -> DataFrame:
    """stop_id, vehicle, start, end, kind, store, lat, lng from events."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.floor((wall_seconds(F.col("ts")) - T0) / 20).alias("q"))
    kind = F.when(F.col("event_type") == "view", "BASE").when(F.col("event_type") == "error", "FAKE_EXIT").when(F.col("event_type") == "signup", "OUTSIDE").otherwise("STORE")
    start = F.col("q") + T0
    store = F.when(F.col("event_type").isin("click", "purchase"), F.col("event_id") * 7 % 40)
    return e.select(
        F.col("event_id").alias("stop_id"), F.col("user_id").alias("vehicle"), start.alias("start"), (start + F.floor(F.col("value") * 20)).alias("end"), kind.alias("kind"), store.alias("store"),
        (-22.9 + F.col("event_id") * 37 % 97 / 1000).alias("lat"), (-43.2 + F.col("event_id") * 53 % 89 / 1000).alias("lng"),
    )


STOPS = f"""stops AS (SELECT event_id AS stop_id, user_id AS vehicle, q + {T0} AS start, q + {T0} + CAST(floor(value * 20) AS BIGINT) AS "end",
 CASE event_type WHEN 'view' THEN 'BASE' WHEN 'error' THEN 'FAKE_EXIT' WHEN 'signup' THEN 'OUTSIDE' ELSE 'STORE' END AS kind,
 CASE WHEN event_type IN ('click', 'purchase') THEN event_id * 7 % 40 END AS store,
 -22.9e0 + (event_id * 37 % 97) / 1e3 AS lat, -43.2e0 + (event_id * 53 % 89) / 1e3 AS lng
 FROM (SELECT *, (CAST(floor(epoch(ts)) AS BIGINT) - {T0}) // 20 AS q FROM events))"""


def stores(spark: SparkSession, d: str) -> DataFrame:
    """store_id, lat_r, lng_r, radius from supplier."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("store_id"), (-22.9 + k * 31 % 97 / 1000).alias("lat_r"), (-43.2 + k * 17 % 89 / 1000).alias("lng_r"), (100 + k * 13 % 200).alias("radius"))


STORES = "stores AS (SELECT s_suppkey AS store_id, -22.9e0 + (s_suppkey * 31 % 97) / 1e3 AS lat_r, -43.2e0 + (s_suppkey * 17 % 89) / 1e3 AS lng_r, 100 + s_suppkey * 13 % 200 AS radius FROM supplier)"


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """delivery, client, vehicle, planned_at, lat, lng from customer; two deliveries a client."""
    k = F.col("c_custkey")
    c = F.floor(k / 2)
    return table(spark, d, "customer").select(
        k.alias("delivery"), c.alias("client"), (k % 150).alias("vehicle"), (T0 + k * 97 % 129600).alias("planned_at"), (-22.9 + c * 41 % 97 / 1000).alias("lat"), (-43.2 + c * 59 % 89 / 1000).alias("lng")
    )


DELIVERIES = f"deliveries AS (SELECT c_custkey AS delivery, c_custkey // 2 AS client, c_custkey % 150 AS vehicle, {T0} + c_custkey * 97 % 129600 AS planned_at, -22.9e0 + ((c_custkey // 2) * 41 % 97) / 1e3 AS lat, -43.2e0 + ((c_custkey // 2) * 59 % 89) / 1e3 AS lng FROM customer)"


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Day entries of planned deliveries: network, store, driver, plate, day, status and clock texts."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    out, go, stay, home = k * 7 % 1440, c % 180, k * 3 % 90, k % 240
    hhmm = lambda m: F.format_string("%02d:%02d", F.floor(m % 1440 / 60), m % 1440 % 60)
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "failed").when(k % 3 == 0, "no_tracker").otherwise("undefined")
    return table(spark, d, "orders").select(
        k.alias("entry"), F.col("o_orderpriority").alias("network"), (c % 40).alias("store"), (c % 50).alias("driver"), (k % 150).alias("vehicle"), F.to_date("o_orderdate").alias("day"), status.alias("status"),
        F.when(k % 11 == 0, "-").otherwise(hhmm(out)).alias("left_base"), hhmm(out + go).alias("arrive"), F.when(k % 13 != 0, hhmm(out + go + stay)).alias("leave"), F.when(k % 5 != 0, hhmm(out + go + stay + home)).alias("back"),
    )


def _clock(m: str) -> str:
    return f"printf('%02d:%02d', ({m}) % 1440 // 60, ({m}) % 1440 % 60)"


_OUT, _ARR, _LEA = "o_orderkey * 7 % 1440", "o_orderkey * 7 % 1440 + o_custkey % 180", "o_orderkey * 7 % 1440 + o_custkey % 180 + o_orderkey * 3 % 90"
ENTRIES = f"""entries AS (SELECT o_orderkey AS entry, o_orderpriority AS network, o_custkey % 40 AS store, o_custkey % 50 AS driver, o_orderkey % 150 AS vehicle, CAST(o_orderdate AS DATE) AS day,
 CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'no_tracker' ELSE 'undefined' END AS status,
 CASE WHEN o_orderkey % 11 = 0 THEN '-' ELSE {_clock(_OUT)} END AS left_base, {_clock(_ARR)} AS arrive, CASE WHEN o_orderkey % 13 <> 0 THEN {_clock(_LEA)} END AS leave,
 CASE WHEN o_orderkey % 5 <> 0 THEN {_clock(_LEA + " + o_orderkey % 240")} END AS back FROM orders)"""


def routes(spark: SparkSession, d: str) -> DataFrame:
    """Planned routes with their outcome from orders: route_id, vehicle, day, store, left_base, arrive, leave, dist_m, label."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    left = T0 + k * 61 % 86400
    arrive = left + c % 200 * 60 - 600
    return table(spark, d, "orders").select(
        k.alias("route_id"), (k % 170).alias("vehicle"), F.to_date("o_orderdate").alias("day"), F.when(k % 17 != 0, c % 40).alias("store"), F.when(k % 19 != 0, left).alias("left_base"), F.when(k % 7 != 0, arrive).alias("arrive"),
        F.when(k % 7 != 0, arrive + k * 11 % 400 * 60 - 3600).alias("leave"), (c * 13 % 4000).cast("double").alias("dist_m"), F.when(k % 4 == 0, "A + B").otherwise(F.concat(F.lit("STORE "), c % 40)).alias("label"),
    )


ROUTES = f"""routes AS (SELECT o_orderkey AS route_id, o_orderkey % 170 AS vehicle, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey % 40 END AS store,
 CASE WHEN o_orderkey % 19 <> 0 THEN {T0} + o_orderkey * 61 % 86400 END AS left_base, CASE WHEN o_orderkey % 7 <> 0 THEN {T0} + o_orderkey * 61 % 86400 + o_custkey % 200 * 60 - 600 END AS arrive,
 CASE WHEN o_orderkey % 7 <> 0 THEN {T0} + o_orderkey * 61 % 86400 + o_custkey % 200 * 60 - 600 + o_orderkey * 11 % 400 * 60 - 3600 END AS leave, CAST(o_custkey * 13 % 4000 AS DOUBLE) AS dist_m,
 CASE WHEN o_orderkey % 4 = 0 THEN 'A + B' ELSE 'STORE ' || CAST(o_custkey % 40 AS VARCHAR) END AS label FROM orders)"""


def plate_of(key: str) -> Column:
    """A plate text from a key: three letters, a digit, a letter or digit, two digits."""
    k = F.col(key)
    letter = lambda n: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (n % 26 + 1).cast("int"), F.lit(1))
    fifth = F.when(k % 2 == 0, F.substring(F.lit("ABCDEFGHIJ"), (k % 10 + 1).cast("int"), F.lit(1))).otherwise((k % 10).cast("string"))
    return F.concat(letter(k), letter(F.floor(k / 26)), letter(k * 3), (k % 7).cast("string"), fifth, F.lpad((k % 100).cast("string"), 2, "0"))


def plate_sql(k: str) -> str:
    letter = lambda n: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(({n}) % 26 + 1 AS INT), 1)"
    return f"({letter(k)} || {letter(f'({k}) // 26')} || {letter(f'({k}) * 3')} || CAST(({k}) % 7 AS VARCHAR) || CASE WHEN ({k}) % 2 = 0 THEN substr('ABCDEFGHIJ', CAST(({k}) % 10 + 1 AS INT), 1) ELSE CAST(({k}) % 10 AS VARCHAR) END || lpad(CAST(({k}) % 100 AS VARCHAR), 2, '0'))"


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371000e0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def hundredths(x: Column) -> Column:
    """Rounded to hundredths, halves up."""
    return F.floor(x * 100 + 0.5) / 100


def hundredths_sql(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"
