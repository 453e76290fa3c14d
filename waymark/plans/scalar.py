"""Queries of scalar expressions, filters and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.functions import time as clock
from waymark.operators import predicates
from waymark.plans import inputs as i
from waymark.plans.catalog import query
from waymark.sources import readers
from waymark.sources.store import table

_FOLD = f"translate({{}}, '{text.ACCENTED}', '{text.PLAIN}')"


@query(f"""SELECT c_custkey AS id, upper({_FOLD.format("trim(regexp_replace('  São ' || c_name || '   é ', '\\s+', ' ', 'g'))")}) AS name_key,
 trim(regexp_replace(regexp_replace(lower({_FOLD.format("'São ' || c_name")}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS score_key FROM customer""")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), text.name_key(F.concat(F.lit("  São "), "c_name", F.lit("   é "))).alias("name_key"), text.score_key(F.concat(F.lit("São "), "c_name")).alias("score_key"))


@query("""SELECT p_partkey AS id, CAST(levenshtein(p_name, p_brand) AS INT) AS edits, floor((1 - levenshtein(p_name, p_brand) / CAST(greatest(length(p_name), length(p_brand)) AS DOUBLE)) * 1e4 + 0.5) / 1e4 AS similarity,
 CAST(CASE WHEN length(p_type) <> length(p_brand) THEN 99 ELSE hamming(p_type, p_brand) END AS INT) AS hamming FROM part""")
def edit_distances(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a, b = F.col("p_name"), F.col("p_brand")
    return p.select(F.col("p_partkey").alias("id"), F.levenshtein(a, b).alias("edits"), (F.floor(text.similarity(a, b) * 1e4 + 0.5) / 1e4).alias("similarity"), text.hamming(F.col("p_type"), b).alias("hamming"))


@query("""SELECT p_partkey AS id, floor((0.6 * jaro_winkler_similarity(p_name, p_type) + 0.4 * (1 - levenshtein(p_name, p_type) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE))) * 1e6 + 0.5) / 1e6 AS score
 FROM (SELECT p_partkey, p_name, lower(p_type) || ' ' || p_name AS p_type FROM part)""")
def hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("other", F.concat(F.lower("p_type"), F.lit(" "), "p_name"))
    return p.select(F.col("p_partkey").alias("id"), (F.floor(text.hybrid_score(F.col("p_name"), F.col("other")) * 1e6 + 0.5) / 1e6).alias("score"))


_PLATE = i.plate_sql("c_custkey")


@query(f"""SELECT c_custkey AS id, plate, regexp_matches(plate, '^[A-Z]{{3}}[0-9][A-Z0-9][0-9]{{2}}$') AS valid,
 CASE WHEN regexp_matches(substr(plate, 5, 1), '[0-9A-J]') THEN substr(plate, 1, 4) || translate(substr(plate, 5, 1), '0123456789ABCDEFGHIJ', 'ABCDEFGHIJ0123456789') || substr(plate, 6) ELSE plate END AS other_series,
 translate(substr(plate, 1, 3), '01', 'OI') || translate(substr(plate, 4), 'OI', '01') AS visual FROM (SELECT c_custkey, {_PLATE} AS plate FROM customer)""")
def plate_forms(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("plate", i.plate_of("c_custkey"))
    p = F.col("plate")
    return c.select(F.col("c_custkey").alias("id"), text.plate_key(F.lower(p)).alias("plate"), text.plate_valid(p).alias("valid"), F.element_at(text.series_variants(p), -1).alias("other_series"), text.visual_key(p).alias("visual"))


@query(f"""SELECT c_custkey AS id, unnest(list_distinct([plate] || list_filter(list_transform(range(1, 8), lambda i: CASE WHEN substr(plate, i, 1) IN ('0','O','1','I','8','B','5','S')
 THEN substr(plate, 1, i - 1) || translate(substr(plate, i, 1), '0O1I8B5S', 'O0I1B8S5') || substr(plate, i + 1) END), lambda x: x IS NOT NULL))) AS variant FROM (SELECT c_custkey, {_PLATE} AS plate FROM customer)""")
def plate_misreadings(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("plate", i.plate_of("c_custkey"))
    return c.select(F.col("c_custkey").alias("id"), F.explode(text.ocr_variants(F.col("plate"))).alias("variant"))


@query("""WITH t AS (SELECT p_partkey AS id, [x FOR x IN list_distinct(string_split(upper(p_name), ' ') || [CAST(p_size % 7 AS VARCHAR)]) IF NOT regexp_matches(x, '^[A-Z]$')] AS a,
 [x FOR x IN list_distinct(string_split(upper(p_name || ' ' || p_type), ' ') || [CAST(p_size % 5 AS VARCHAR)])] AS b FROM part),
 n AS (SELECT *, len(list_intersect(a, b)) AS same, [x FOR x IN a IF regexp_matches(x, '^[0-9]{1,3}$')] AS na, [x FOR x IN b IF regexp_matches(x, '^[0-9]{1,3}$')] AS nb, [x FOR x IN a IF NOT regexp_matches(x, '^[0-9]+$')] AS wa, [x FOR x IN b IF NOT regexp_matches(x, '^[0-9]+$')] AS wb FROM t)
 SELECT id, CAST(CASE WHEN len(list_intersect(na, nb)) = 0 THEN greatest(len(wa), len(wb)) - len(list_intersect(wa, wb)) + 3 ELSE greatest(len(a), len(b)) - same END AS INT) AS score FROM n""")
def token_scores(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a = text.core_tokens(F.concat_ws(" ", "p_name", (F.col("p_size") % 7).cast("string")))
    b = text.core_tokens(F.concat_ws(" ", "p_name", "p_type", (F.col("p_size") % 5).cast("string")))
    return p.select(F.col("p_partkey").alias("id"), text.token_score(a, b).cast("int").alias("score"))


@query("""SELECT s_suppkey AS id, 'RUA ' || 'SUP ' || CAST(s_suppkey AS VARCHAR) AS street, 'RUA SUP,' || CAST(s_suppkey AS VARCHAR) AS street_number,
 CASE WHEN s_suppkey % 3 = 0 THEN 'north' WHEN s_suppkey % 3 = 1 THEN 'south' ELSE 'other' END AS network, CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 4, '0') END AS code FROM supplier""")
def address_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    address = F.concat(F.lit("R. súp  "), k.cast("string"), F.lit(" 20000-123"))
    label = F.when(k % 3 == 0, "Norte 1").when(k % 3 == 1, "Sul 2").otherwise("-")
    shop = F.when(k % 2 == 0, F.concat(F.lpad(k.cast("string"), 4, "0"), F.lit(" - Shop"))).otherwise("Shop")
    return s.select(k.alias("id"), text.address_key(address).alias("street"), text.street_number_key(address).alias("street_number"), text.keyword_class(label, {"north": "NORTE", "south": "SUL"}, "other").alias("network"), text.code_and_name(shop)[0].alias("code"))


@query("""WITH d AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders)
 SELECT id, CAST(date_trunc('week', d) AS DATE) AS week_first, CAST(date_trunc('week', d) AS DATE) + 6 AS week_last, CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) AS prev_month_first, CAST(date_trunc('month', d) AS DATE) - 1 AS prev_month_last,
 d - 10 AS span_first, d - 1 AS span_last, CASE WHEN dayofweek(d + 1) = 0 THEN d + 2 ELSE d + 1 END AS next_working, DATE '1899-12-30' + CAST(40000 + id % 1000 AS INT) AS serial, d AS dmy FROM d""")
def calendar(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    week, month = clock.period_bounds("week", F.col("d")), clock.previous_bounds("month", F.col("d"))
    span = clock.previous_span(F.col("d"), F.date_add("d", 9))
    return o.select("id", week[0].alias("week_first"), week[1].alias("week_last"), month[0].alias("prev_month_first"), month[1].alias("prev_month_last"), span[0].alias("span_first"), span[1].alias("span_last"), clock.next_working_day(F.col("d")).alias("next_working"), clock.serial_date(40000 + F.col("id") % 1000).alias("serial"), clock.dmy_date(F.date_format("d", "dd/MM/yyyy")).alias("dmy"))


@query(f"""WITH {i.ENTRIES}, m AS (SELECT *, CASE WHEN left_base = '-' THEN NULL ELSE CAST(substr(left_base, 1, 2) AS INT) * 60 + CAST(substr(left_base, 4, 2) AS INT) END AS l, CAST(substr(arrive, 1, 2) AS INT) * 60 + CAST(substr(arrive, 4, 2) AS INT) AS a FROM entries)
 SELECT entry, CAST(CASE WHEN a < l THEN a - l + 1440 ELSE a - l END AS INT) AS gap, CASE WHEN a // 60 < 6 THEN 'night' WHEN a // 60 < 12 THEN 'morning' WHEN a // 60 < 18 THEN 'afternoon' ELSE 'evening' END AS shift,
 CAST(entry % 100 // 60 AS VARCHAR) || 'h' || lpad(CAST(entry % 100 % 60 AS VARCHAR), 2, '0') || 'min' AS shown, CAST(entry % 100 AS INT) AS parsed, entry % 3 * 86400 + entry % 24 * 3600 + 1801 AS seconds FROM m""")
def clock_times(spark: SparkSession, d: str) -> DataFrame:
    e = i.entries(spark, d)
    shown = clock.format_minutes(F.col("entry") % 100)
    long = F.concat((F.col("entry") % 3).cast("string"), F.lit("D "), F.format_string("%02d", F.col("entry") % 24), F.lit(":30:01"))
    return e.select("entry", clock.clock_gap(F.col("left_base"), F.col("arrive")).cast("int").alias("gap"), clock.shift_of(F.col("arrive")).alias("shift"), shown.alias("shown"), clock.parse_minutes(shown).alias("parsed"), clock.parse_duration(long).alias("seconds"))


@query(f"""WITH {i.STOPS} SELECT stop_id, {i.hundredths_sql(i.haversine_sql('lat', 'lng', '-22.9e0', '-43.2e0'))} AS round_m, {i.hundredths_sql('sqrt(pow(lat + 22.9e0, 2) + pow(lng + 43.2e0, 2)) * 111000')} AS flat_m,
 CAST(CASE WHEN stop_id % 600 <= 500 THEN greatest(CAST(ceil((stop_id % 600) / 50e0) * 50 AS INT), 50) END AS INT) AS step, CASE WHEN stop_id % 9 = 0 THEN 'incomplete' WHEN stop_id % 9 = 1 THEN 'swapped' WHEN stop_id % 9 = 2 THEN 'zero' WHEN stop_id % 9 = 3 THEN 'outside' END AS problem,
 greatest(0, CAST(ceil(90 * (stop_id % 50) / 100e0 - stop_id % 7 - 1e-9) AS BIGINT)) AS missing FROM stops""")
def distances(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d)
    lat, lng, k = F.col("lat"), F.col("lng"), F.col("stop_id")
    a = F.when(k % 9 == 0, None).when(k % 9 == 1, lng).when(k % 9 == 3, lat + 10).otherwise(lat)
    b = F.when(k % 9 == 1, lat).when(k % 9 == 2, F.lit(0.0)).otherwise(lng)
    home = (F.lit(-22.9), F.lit(-43.2))
    return s.select("stop_id", i.hundredths(geo.haversine(lat, lng, *home)).alias("round_m"), i.hundredths(geo.planar(lat, lng, *home)).alias("flat_m"), geo.distance_step(k % 600).cast("int").alias("step"), geo.coordinate_problem(a, b, i.BOX).alias("problem"), geo.shortfall(F.lit(90), k % 50, k % 7).cast("long").alias("missing"))


@query(f"WITH {i.ENTRIES} SELECT entry, network, status FROM entries WHERE network IN ('1-URGENT', '2-HIGH') AND day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND status IN ('delivered', 'failed')")
def multi_filter(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    return predicates.matching(i.entries(spark, d), {"network": ["1-URGENT", "2-HIGH"], "status": ["delivered", "failed"], "store": []}, {"day": (dt.date(1996, 1, 1), dt.date(1998, 12, 31))}).select("entry", "network", "status")


@query("""SELECT o_custkey AS who, unnest(CASE WHEN o_custkey % 4 = 0 THEN ['1-URGENT', '2-HIGH', '5-LOW'] ELSE list_intersect(list_sort(list(DISTINCT o_orderpriority)), ['1-URGENT', '2-HIGH', '5-LOW']) END) AS network FROM orders GROUP BY o_custkey""")
def permitted_networks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("who")).agg(F.collect_set("o_orderpriority").alias("asked"))
    asked = F.when(F.col("who") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("asked"))
    return o.select("who", F.explode(predicates.permitted(asked, F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("5-LOW")))).alias("network"))


@query(f"""WITH {i.STOPS}, m AS (SELECT *, start % 86400 // 3600 AS hs, "end" % 86400 // 3600 AS he, count(*) OVER (PARTITION BY vehicle, store) AS n FROM stops)
 SELECT stop_id FROM m WHERE NOT coalesce(hs < 3 AND "end" - start > 7200 AND he < 6 AND n = 1 AND store IS NOT NULL, false)""")
def without_lone_night_stops(spark: SparkSession, d: str) -> DataFrame:
    from waymark.operators.sequence import alone_of_code

    return alone_of_code(i.stops(spark, d), ["vehicle"], "store", predicates.night_stay(F.col("start"), F.col("end"))).select("stop_id")


@query(f"""WITH {i.STOPS} SELECT stop_id, CASE WHEN kind = 'STORE' THEN 'STORE' WHEN kind = 'BASE' AND "end" - start > 900 THEN 'BASE' WHEN kind = 'BASE' THEN 'FAKE_EXIT' WHEN "end" - start < 600 THEN 'FAKE_EXIT' ELSE 'OUTSIDE' END AS class,
 CASE WHEN kind = 'STORE' THEN 'delivered' WHEN stop_id % 5 = 0 THEN 'no_tracker' WHEN kind <> 'BASE' THEN 'on_route' ELSE 'waiting' END AS state,
 CASE WHEN stop_id % 5 = 0 THEN 'untracked' WHEN stop_id % 5 = 1 THEN 'stale' ELSE 'tracked' END AS tracker,
 CASE WHEN stop_id % 7 = 0 THEN 'no_signal' WHEN stop_id % 7 = 1 THEN 'never_left' WHEN stop_id % 7 = 2 THEN 'signal_gap' WHEN stop_id % 3000 <= 500 THEN 'passed_by' WHEN stop_id % 3000 <= 2000 THEN 'near' ELSE 'did_not_go' END AS cause FROM stops""")
def classifications(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d)
    kind, k = F.col("kind"), F.col("stop_id")
    return s.select(
        "stop_id",
        predicates.stop_class(kind == "BASE", kind == "STORE", kind.isin("OUTSIDE", "FAKE_EXIT"), F.col("end") - F.col("start")).alias("class"),
        predicates.live_state(kind == "STORE", k % 5 != 0, kind != "BASE").alias("state"),
        predicates.tracker_state(F.when(k % 5 != 0, F.when(k % 5 == 1, 1).otherwise(2)), F.lit(2)).alias("tracker"),
        predicates.pending_cause(k % 7 == 1, k % 7 == 0, k % 7 == 2, k % 3000).alias("cause"),
    )


@query("SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-06-01' AND (o_orderstatus = 'P' OR CAST(o_orderdate AS DATE) + 90 >= DATE '1998-06-01')")
def valid_intervals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("first", F.to_date("o_orderdate"))
    last = F.when(F.col("o_orderstatus") != "P", F.date_add("first", 90))
    return o.where(predicates.valid_on(F.lit("1998-06-01").cast("date"), F.col("first"), last)).select(F.col("o_orderkey").alias("id"))


@query("""SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '[["k","' || json_extract_string(props, '$.k') || '"]]' AS canonical FROM events""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    from waymark.operators.rowsets import canonical_json

    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), canonical_json(F.col("props")).alias("canonical"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'swap' WHEN c_custkey % 3 = 1 THEN 'cancel' ELSE 'add' END AS kind, """ + _PLATE + """ AS plate, CAST(c_custkey % 40 AS INT) AS store FROM customer""")
def change_messages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    verb = F.when(k % 3 == 0, "Troca").when(k % 3 == 1, "cancel").otherwise("add")
    said = F.concat(verb, F.lit(" "), F.lower(i.plate_of("c_custkey")), F.lit(" loja "), (k % 40).cast("string"), F.lit("\n;"))
    return readers.changes(table(spark, d, "customer").select(k.alias("id"), said.alias("text")), "text").select("id", "kind", "plate", "store")


@query("SELECT p_partkey AS id, p_brand AS brand, CAST(trunc(p_retailprice) AS INT) AS price, CAST(NULL AS VARCHAR) AS missing FROM part")
def named_projection(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"id": ("P_PARTKEY", "long"), "brand": ("p_BRAND", "string"), "price": ("p_retailprice", "int"), "missing": ("no such", "string")}
    return readers.renamed(table(spark, d, "part"), wanted)


@query("SELECT p_partkey AS id, p_brand AS brand, p_name AS label FROM part")
def inferred_columns(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("c1"), F.col("p_brand").alias("c2"))
    found = readers.by_content(p.drop("id"), {"brand": r"^Brand#[0-9]+$", "label": r"^[a-z]+ [a-z]+$"})
    return p.select("id", *[F.col(c).alias(n) for n, c in found.items()])


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'manifest' WHEN doc_id % 3 = 1 THEN 'report' ELSE 'unknown' END AS type FROM documents) SELECT type, count(*) AS n FROM d GROUP BY type""")
def document_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    head = F.when(k % 3 == 0, "Day manifést 7").when(k % 3 == 1, "the report").otherwise("letter")
    return table(spark, d, "documents").select(readers.document_type(head).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {i.STOPS} SELECT stop_id FROM stops WHERE CASE WHEN start // 86400 = 19723 THEN ({i.T0} + 90000 - "end") / 60e0 <= 4 ELSE ({i.T0} + 90000 - "end") / 60e0 <= 360 AND "end" >= (start // 86400 + 1) * 86400 END""")
def fresh_cache(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).withColumn("day", clock.day_of(F.col("start")))
    return readers.fresh(s, "end", "day", F.lit(i.T0 + 90000), F.lit(19723)).select("stop_id")
