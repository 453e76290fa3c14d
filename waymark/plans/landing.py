"""Queries of readers, sinks and text grammars: what is written to the shared folder and read back equals its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans import inputs as i
from waymark.plans.catalog import query
from waymark.sources import positioned, readers, sinks
from waymark.sources.store import shared_path, table


@query("SELECT event_id, user_id, event_type, floor(value * 100 + 0.5) / 100 AS value FROM events")
def landed_positions(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "landing")
    table(spark, d, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    got = readers.json_records(spark, path, "event_id long, user_id long, event_type string, value double")
    return got.select("event_id", "user_id", "event_type", i.hundredths(F.col("value")).alias("value"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def exported_report(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "report")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    sinks.report(rows, path, tab="segment")
    return spark.read.schema("id long, name string, segment string").csv(path, header=True)


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-06-01' GROUP BY 1")
def days_of_partitions(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "days")
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.date_trunc("month", F.to_date("o_orderdate")).cast("date").alias("month"), "o_orderkey")
    sinks.replace_partitions(o, path, ["month"])
    return readers.days(spark, path, "1995-03-01", "1995-05-31").groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey % 700 AS k, max(o_orderkey) AS made FROM orders GROUP BY 1")
def resolution_log(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "log")
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 700).alias("k"), F.col("o_orderkey").alias("made"))
    for part in (o.where("made % 2 = 0"), o.where("made % 2 = 1")):
        sinks.append_log(part, path)
    return spark.read.parquet(path).groupBy("k").agg(F.max("made").alias("made"))


@query("SELECT s_suppkey AS id, 0 AS line_no, 'name ' || s_name AS line FROM supplier UNION ALL SELECT s_suppkey, 1, 'nation ' || CAST(s_nationkey AS VARCHAR) FROM supplier")
def text_documents(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "texts")
    s = table(spark, d, "supplier")
    s.select(F.concat(F.lit("name "), "s_name", F.lit("\r\nnation "), F.col("s_nationkey").cast("string")).alias("value"), F.col("s_suppkey").alias("id")).repartition("id").write.partitionBy("id").text(path)
    lines = readers.document_lines(spark, path, "*.txt")
    return lines.select(F.regexp_extract("path", r"id=([0-9]+)/", 1).cast("long").alias("id"), "line_no", "line")


@query("SELECT p_partkey AS id, p_size + 1 AS size FROM part")
def parse_with_most_rows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(";", F.col("p_brand"), (F.col("p_size") + 1).cast("string")).alias("line"))
    parses = {"comma": p.select("id", F.split_part("line", F.lit(","), F.lit(2)).try_cast("int").alias("size")), "semicolon": p.select("id", F.split_part("line", F.lit(";"), F.lit(2)).try_cast("int").alias("size"))}
    return readers.best_parse(parses, F.col("size").isNotNull())[1]


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """Text lines of manifests: a load, its car and its driver, then one line for each invoice, with noise between them."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders").select((c % 25).alias("doc"), (k % 40).alias("load"), k.alias("k"), c.alias("c"))
    at = lambda n: (F.col("load") * 1_000_000_000 + n).alias("place")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("line")
    s = lambda x: x.cast("string")
    loads = o.select("doc", "load").distinct()
    load = F.col("load")
    heads = [
        loads.select("doc", at(0), text("LOAD   ", s(load))),
        loads.where("load % 7 <> 0").select("doc", at(1), text("CAR ", s(load % 9), " ABC", s(load % 10), "D", s(load % 90 + 10))),
        loads.where("load % 5 <> 0").select("doc", at(2), text("Driver: Name ", s(load))),
        loads.select("doc", at(3), text("---- page ", s(load), " ----")),
    ]
    place = F.col("c") % 3
    address = F.when(place == 0, text("Street ", s(F.col("c") % 12), ", ", s(F.col("c") % 200), " Centre")).when(place == 1, text("Square ", s(F.col("c") % 12))).otherwise(text("Road, Hill, ", s(F.col("c") % 9)))
    items = o.select("doc", at(F.col("k") + 10), text("  ", s(F.col("k") % 30 + 1), "  NF", s(F.col("k")), " : ", address))
    early = o.select("doc").distinct().select("doc", F.lit(-1).cast("long").alias("place"), F.lit("1 NF0 : before any load").alias("line"))
    out = items.unionByName(early)
    for h in heads:
        out = out.unionByName(h)
    return out


@query("""WITH o AS (SELECT o_custkey % 25 AS doc, o_orderkey % 40 AS load, o_orderkey AS k, o_custkey AS c FROM orders)
 SELECT doc, CAST(load AS VARCHAR) AS load, CASE WHEN load % 7 <> 0 THEN 'ABC' || load % 10 || 'D' || (load % 90 + 10) END AS plate, CASE WHEN load % 5 <> 0 THEN 'Name ' || load END AS driver, CAST(k % 30 + 1 AS INT) AS place, k AS invoice,
  CASE c % 3 WHEN 0 THEN 'Street ' || c % 12 WHEN 1 THEN 'Square ' || c % 12 ELSE 'Road, Hill, ' || c % 9 END AS street, CASE c % 3 WHEN 0 THEN CAST(c % 200 AS VARCHAR) ELSE '' END AS number, CASE c % 3 WHEN 0 THEN 'Centre' ELSE '' END AS district FROM o""")
def manifest_lines(spark: SparkSession, d: str) -> DataFrame:
    heads = {"load": r"^LOAD ([0-9]+)$", "plate": r"^CAR [0-9]+ ([A-Z]{3}[0-9][A-Z0-9][0-9]{2})$", "driver": r"^Driver: (.+)$"}
    got = readers.blocks(_manifest(spark, d), ["doc"], "place", "line", heads, r"^([0-9]+) NF([0-9]+) : (.*)$", {"at": 1, "invoice": 2, "address": 3})
    part = readers.street_and_number(F.col("address"))
    return got.select("doc", "load", "plate", "driver", F.col("at").cast("int").alias("place"), F.col("invoice").cast("long").alias("invoice"), part["street"].alias("street"), part["number"].alias("number"), part["rest"].alias("district"))


@query(f"""WITH {i.STOPS} SELECT CAST(vehicle AS VARCHAR) AS plate, CAST(stop_id AS INT) AS stop, CAST(start // 60 % 1440 AS INT) AS arrive, CAST("end" // 60 % 1440 AS INT) AS leave, CAST(store AS INT) AS code FROM stops""")
def position_report_lines(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d)
    hm = lambda t: F.format_string("%02d:%02d", F.floor(t / 3600) % 24, F.floor(t / 60) % 60)
    head = s.select("vehicle").distinct().select("vehicle", F.lit(0).cast("long").alias("place"), F.concat(F.lit("Vehicle:  "), F.col("vehicle").cast("string")).alias("line"))
    where = F.when(F.col("store").isNotNull(), F.concat(F.col("store").cast("string"), F.lit(" - STORE"))).otherwise("ROAD")
    body = s.select("vehicle", (F.col("stop_id") + 1).alias("place"), F.concat(F.col("stop_id").cast("string"), F.lit("   "), hm(F.col("start")), F.lit(" "), hm(F.col("end")), F.lit(" "), where).alias("line"))
    got = readers.blocks(head.unionByName(body), ["vehicle"], "place", "line", {"plate": "^Vehicle: ([0-9]+)$"}, r"^([0-9]+) ([0-9]{2}):([0-9]{2}) ([0-9]{2}):([0-9]{2}) (?:([0-9]+) - )?.*$", {"stop": 1, "h1": 2, "m1": 3, "h2": 4, "m2": 5, "code": 6})
    minutes = lambda h, m: (F.col(h).cast("int") * 60 + F.col(m).cast("int"))
    return got.select("plate", F.col("stop").cast("int").alias("stop"), minutes("h1", "m1").alias("arrive"), minutes("h2", "m2").alias("leave"), F.col("code").try_cast("int").alias("code"))


@query("""SELECT 'ABC' || o_custkey % 10 || 'D' || (o_custkey % 80 + 10) AS plate, CAST(o_custkey % 80 AS VARCHAR) AS load, o_orderkey % 50 AS place, o_orderkey AS invoice FROM orders WHERE o_orderkey % 50 > 0 AND o_custkey % 4 <> 3""")
def route_order_lines(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    o = table(spark, d, "orders").select(k.alias("k"), c.alias("c"))
    head = o.select("c").distinct().select("c", F.lit(0).cast("long").alias("place"), F.concat(F.lit("CARGO VEHICLE TOWN - ABC"), s(F.col("c") % 10), F.lit("D"), s(F.col("c") % 80 + 10)).alias("line"))
    # a row needs a numeric load, a positive place and an invoice
    load = F.when(F.col("c") % 4 == 3, F.lit("TOTAL")).otherwise(s(F.col("c") % 80))
    body = o.select("c", (F.col("k") + 1).alias("place"), F.concat(load, F.lit(" | "), s(F.col("k") % 50), F.lit(" | NF "), s(F.col("k"))).alias("line"))
    got = readers.blocks(head.unionByName(body), ["c"], "place", "line", {"plate": r"^CARGO VEHICLE .* - ([A-Z0-9]+)$"}, r"^([0-9]+) \| ([0-9]*[1-9][0-9]*) \| NF ([0-9]+)$", {"load": 1, "at": 2, "invoice": 3})
    return got.select("plate", "load", F.col("at").cast("long").alias("place"), F.col("invoice").cast("long").alias("invoice"))


@query("SELECT o_orderkey AS id, o_orderkey % 1000 AS written FROM orders WHERE o_orderkey % 1000 >= 400")
def purged_cache(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "cache")
    table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 1000).alias("written")).write.parquet(path)
    sinks.purge(spark, path, F.col("written") >= 400)
    return spark.read.schema("id long, written long").parquet(path)


@query("""WITH c AS (SELECT s_nationkey AS net, 'Store ' || s_suppkey % 30 AS canonical FROM supplier GROUP BY ALL) SELECT c_custkey AS id, canonical FROM customer LEFT JOIN c ON net = c_nationkey AND upper(canonical) = 'STORE ' || c_custkey % 40""")
def canonical_store_names(spark: SparkSession, d: str) -> DataFrame:
    from waymark.operators.rowsets import canonical_names

    known = table(spark, d, "supplier").select(F.col("s_nationkey").alias("net"), F.concat(F.lit("Store "), (F.col("s_suppkey") % 30).cast("string")).alias("canonical"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("net"), F.concat(F.lit("  stóre  "), (F.col("c_custkey") % 40).cast("string")).alias("name"))
    return canonical_names(asked, known, "net", "name").select("id", "canonical")


_PLATE = "^[A-Z]{3}[0-9][A-Z0-9][0-9]{2}$"
_LABELS = {"plate": "^Plate$", "code": "^Code$", "name": "^Name$", "town": "^Town$"}
_BANDS = {"plate": (0.0, 40.0), "code": (40.0, 100.0), "name": (100.0, 250.0), "town": (250.0, 9999.0)}


def _page_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of pages of 25 records each: columns that lie elsewhere on each page, baselines that waver, a name over three lines, a footer."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("k"), F.col("o_custkey").alias("c"), F.floor(k / 25).alias("page"), (k % 25).alias("r"))
    lost = F.col("page") % 5 == 0  # pages without a heading have their columns at the usual places
    shift = lambda n: F.when(lost, F.lit(0)).otherwise(F.col("page") % 7 * n)
    s = lambda x: x.cast("string")
    top = 800 - F.col("r") * 30
    waver = lambda n: (F.col("k") * 7 + n) % 3 * 0.5 - 0.5
    item = lambda x, y, text: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), text.alias("text"))
    plate = F.concat(F.lit("ABC"), s(F.col("c") % 10), F.lit("D"), s(F.col("c") % 80 + 10))
    name = 120 + shift(9)
    body = [item(10 + shift(3), top + waver(0), plate), item(60 + shift(5), top + waver(1), s(F.col("k"))), item(name, top + 9 + waver(2), F.lit(" CUSTOMER ")), item(name, top + waver(2), s(F.col("c"))), item(name, top - 9 + waver(0), F.lit("BROTHERS")), item(name + 60, top - 9 + waver(1), F.lit("LTD")), item(300 + shift(11), top + waver(1), F.concat(F.lit("TOWN "), s(F.col("c") % 30)))]
    head = [item(10 + shift(3), F.lit(830), F.lit("Plate")), item(60 + shift(5), F.lit(830.4), F.lit("Code")), item(name, F.lit(829.7), F.lit("Name")), item(300 + shift(11), F.lit(830), F.lit("Town"))]
    foot = [item(70 + shift(5), F.lit(20), F.concat(F.lit("page "), s(F.col("page"))))]
    pages = o.select("page").distinct()
    parts = [o.select("page", F.inline(F.array(*body))), pages.where(~lost).select("page", F.inline(F.array(*head))), pages.select("page", F.inline(F.array(*foot)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT o_orderkey // 25 AS page, 'ABC' || o_custkey % 10 || 'D' || (o_custkey % 80 + 10) AS plate, o_orderkey AS code, 'CUSTOMER ' || o_custkey || ' BROTHERS LTD' AS name, 'TOWN ' || o_custkey % 30 AS town FROM orders""")
def positioned_records(spark: SparkSession, d: str) -> DataFrame:
    got = positioned.records(_page_items(spark, d), ["page"], _LABELS, _BANDS, ("plate", _PLATE), ["name"], missing=1)
    return got.select("page", "plate", F.col("code").cast("long").alias("code"), "name", "town")
