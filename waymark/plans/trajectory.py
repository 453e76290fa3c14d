"""Queries of sequence operators and grouped kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import kernels, sequence
from waymark.plans import inputs as i
from waymark.plans.catalog import query

_S = f"WITH {i.STOPS}, w AS (SELECT *, lag(\"end\") OVER v AS pe, lag(store) OVER v AS ps, lead(start) OVER v AS ns, lead(lat) OVER v AS nlat, lead(lng) OVER v AS nlng, lag(lat) OVER v AS plat, lag(lng) OVER v AS plng, lag(kind) OVER v AS pk FROM stops WINDOW v AS (PARTITION BY vehicle ORDER BY start, stop_id))"


@query(_S + ", g AS (SELECT *, sum(CASE WHEN start - pe >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY start, stop_id) AS session FROM w) SELECT stop_id, vehicle, CAST(session AS BIGINT) AS session FROM g")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sequence.gap_sessions(i.stops(spark, d), ["vehicle"], "start", "end", 3600, "stop_id").select("stop_id", "vehicle", "session")


@query(f"""WITH {i.STOPS}, w AS (SELECT *, lag("end") OVER (PARTITION BY vehicle, store ORDER BY start, stop_id) AS pe FROM stops WHERE store IS NOT NULL),
 g AS (SELECT *, sum(CASE WHEN start - pe >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle, store ORDER BY start, stop_id) AS session FROM w),
 r AS (SELECT *, row_number() OVER (PARTITION BY vehicle, store, session ORDER BY CAST(start % 86400 // 3600 < 3 AND "end" - start > 7200 AND "end" % 86400 // 3600 < 6 AS INT), "end" - start DESC, start, stop_id) AS r FROM g)
 SELECT stop_id, vehicle, store, CAST(session AS BIGINT) AS session FROM r WHERE r = 1""")
def visit_dedup(spark: SparkSession, d: str) -> DataFrame:
    from waymark.operators.predicates import night_stay

    s = i.stops(spark, d).where("store is not null")
    return sequence.longest_per_session(s, ["vehicle", "store"], "start", "end", 3600, night_stay(F.col("start"), F.col("end")), "stop_id").select("stop_id", "vehicle", "store", "session")


@query(_S + """, r AS (SELECT *, sum(CASE WHEN pk IS NOT NULL AND kind <> pk THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY start, stop_id) AS run FROM w),
 n AS (SELECT vehicle, kind, run, count(*) AS n, min(start) AS first, max(start) AS last FROM r GROUP BY ALL) SELECT vehicle, kind, n, first, last FROM n QUALIFY row_number() OVER (PARTITION BY vehicle, kind ORDER BY n DESC, run) = 1""")
def longest_runs(spark: SparkSession, d: str) -> DataFrame:
    return sequence.longest_run(i.stops(spark, d), ["vehicle"], ["start", "stop_id"], "kind")


@query(f"""WITH {i.STOPS}, s AS (SELECT DISTINCT vehicle, start // 900 AS slot FROM stops), g AS (SELECT *, slot - row_number() OVER (PARTITION BY vehicle ORDER BY slot) AS i FROM s)
 SELECT vehicle, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS n FROM g GROUP BY vehicle, i""")
def slot_islands(spark: SparkSession, d: str) -> DataFrame:
    return sequence.islands(i.stops(spark, d).withColumn("slot", F.floor(F.col("start") / 900)), ["vehicle"], "slot")


@query(f"""WITH {i.STOPS} SELECT stop_id, max(CASE WHEN kind = 'BASE' THEN "end" END) OVER (PARTITION BY vehicle ORDER BY start, stop_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_base,
 min(CASE WHEN kind = 'BASE' THEN start END) OVER (PARTITION BY vehicle ORDER BY start, stop_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back_at FROM stops""")
def base_departure_and_return(spark: SparkSession, d: str) -> DataFrame:
    base = F.col("kind") == "BASE"
    out = sequence.last_before(i.stops(spark, d), ["vehicle"], ["start", "stop_id"], F.when(base, F.col("end")), "left_base")
    return sequence.first_after(out, ["vehicle"], ["start", "stop_id"], F.when(base, F.col("start")), "back_at").select("stop_id", "left_base", "back_at")


@query(f"""WITH {i.STOPS}, l AS (SELECT *, max(CASE WHEN kind <> 'BASE' THEN "end" END) OVER (PARTITION BY vehicle) AS lo FROM stops)
 SELECT vehicle, max(lo) AS last_out, min(CASE WHEN kind = 'BASE' AND start >= lo AND "end" - start >= 600 THEN start END) AS back_at FROM l GROUP BY vehicle""")
def return_to_base(spark: SparkSession, d: str) -> DataFrame:
    return sequence.return_after_last(i.stops(spark, d), ["vehicle"], "start", "end", F.col("kind") == "BASE", 600)


_JUMP = i.haversine_sql("lat", "lng", "nlat", "nlng")
_GAPS = _S + f""", j AS (SELECT *, {_JUMP} AS jump, greatest(0, ns - "end") / 3600e0 AS h FROM w WHERE ns IS NOT NULL),
 gaps AS (SELECT vehicle, start AS gap_start, ns AS gap_end, (ns - start) / 60e0 AS minutes, jump, lat AS lat_a, lng AS lng_a, nlat AS lat_b, nlng AS lng_b FROM j WHERE jump > 3000 AND (h = 0 OR jump / 1000 > 100 * h) AND (ns - start) / 60e0 >= 15)"""


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return sequence.impossible_jumps(i.stops(spark, d), ["vehicle"], "start", "end", "stop_id", 3000, 100, 15)


@query(_GAPS + f" SELECT vehicle, gap_start, gap_end, {i.hundredths_sql('minutes')} AS minutes, {i.hundredths_sql('jump')} AS jump_m FROM gaps")
def signal_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).select("vehicle", "gap_start", "gap_end", i.hundredths(F.col("minutes")).alias("minutes"), i.hundredths(F.col("jump_m")).alias("jump_m"))


_FIT = _GAPS + f""", {i.DELIVERIES}, f AS (SELECT delivery, gap_start, {i.haversine_sql('lat_a', 'lng_a', 'lat', 'lng')} + {i.haversine_sql('lat', 'lng', 'lat_b', 'lng_b')} AS way, jump, minutes FROM deliveries JOIN gaps USING (vehicle)),
 k AS (SELECT *, way - jump AS detour FROM f WHERE way - jump <= 3000 OR way / 1000 / 40 * 60 + 5 <= minutes)"""


@query(_FIT + f" SELECT delivery, gap_start, {i.hundredths_sql('detour')} AS detour_m FROM k QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY gap_start) = 1")
def first_fitting_gap(spark: SparkSession, d: str) -> DataFrame:
    return sequence.fitting_gap(i.deliveries(spark, d), _gaps(spark, d), ["vehicle"], ["delivery"], True).select("delivery", "gap_start", i.hundredths(F.col("detour_m")).alias("detour_m"))


@query(_FIT + f" SELECT delivery, gap_start, {i.hundredths_sql('detour')} AS detour_m FROM k QUALIFY row_number() OVER (PARTITION BY delivery ORDER BY detour, gap_start) = 1")
def least_detour_gap(spark: SparkSession, d: str) -> DataFrame:
    return sequence.fitting_gap(i.deliveries(spark, d), _gaps(spark, d), ["vehicle"], ["delivery"], False).select("delivery", "gap_start", i.hundredths(F.col("detour_m")).alias("detour_m"))


@query(_GAPS + """, o AS (SELECT vehicle, start AS s, "end" AS e FROM stops WHERE kind = 'BASE'), c AS (SELECT g.vehicle, gap_start, gap_end, sum(greatest(0, least(gap_end, e) - greatest(gap_start, s))) AS c FROM gaps g LEFT JOIN o ON g.vehicle = o.vehicle GROUP BY ALL)
 SELECT vehicle, gap_start, gap_end FROM c WHERE 100 * coalesce(c, 0) < 50 * (gap_end - gap_start)""")
def gaps_without_outages(spark: SparkSession, d: str) -> DataFrame:
    outages = i.stops(spark, d).where("kind = 'BASE'").select("vehicle", F.col("start").alias("start_r"), F.col("end").alias("end_r"))
    return sequence.without_covered(_gaps(spark, d), outages, ["vehicle"], 50, 3600).select("vehicle", "gap_start", "gap_end")


@query(_S + f" SELECT vehicle, {i.hundredths_sql('sum(' + i.haversine_sql('plat', 'plng', 'lat', 'lng') + ')')} AS metres, count(*) AS points FROM w GROUP BY vehicle")
def path_lengths(spark: SparkSession, d: str) -> DataFrame:
    return sequence.path_length(i.stops(spark, d), ["vehicle"], ["start", "stop_id"]).withColumn("metres", i.hundredths(F.col("metres")))


@query(f"""WITH RECURSIVE {i.STOPS}, e AS (SELECT vehicle, start // 86400 AS day, start AS t, stop_id, "end" - start AS dwell, -22.9e0 + (stop_id * 37 % 97) / 4e4 AS lat, -43.2e0 + (stop_id * 53 % 89) / 4e4 AS lng FROM stops),
 n AS (SELECT *, row_number() OVER (PARTITION BY vehicle, day ORDER BY t, stop_id) AS r FROM e),
 walk AS (SELECT vehicle, day, r, t, dwell, lat AS alat, lng AS alng, 0 AS stay FROM n WHERE r = 1
  UNION ALL SELECT n.vehicle, n.day, n.r, n.t, n.dwell, CASE WHEN {i.haversine_sql('alat', 'alng', 'n.lat', 'n.lng')} <= 150 THEN alat ELSE n.lat END, CASE WHEN {i.haversine_sql('alat', 'alng', 'n.lat', 'n.lng')} <= 150 THEN alng ELSE n.lng END,
   CASE WHEN {i.haversine_sql('alat', 'alng', 'n.lat', 'n.lng')} <= 150 THEN stay ELSE stay + 1 END FROM walk JOIN n ON n.vehicle = walk.vehicle AND n.day = walk.day AND n.r = walk.r + 1),
 s AS (SELECT vehicle, day, stay, min(t) AS arrive, max_by(t + dwell, r) AS true_end, count(*) AS events FROM walk GROUP BY ALL),
 l AS (SELECT *, coalesce(lead(arrive) OVER (PARTITION BY vehicle, day ORDER BY stay), true_end) AS leave FROM s)
 SELECT vehicle, day, CAST(stay AS INT) AS stay, arrive, leave, true_end, events FROM l WHERE leave - arrive >= 300""")
def stay_points(spark: SparkSession, d: str) -> DataFrame:
    e = i.stops(spark, d).select("vehicle", F.floor(F.col("start") / 86400).alias("day"), F.col("start").alias("t"), "stop_id", (F.col("end") - F.col("start")).alias("dwell"), (-22.9 + F.col("stop_id") * 37 % 97 / 40000).alias("lat"), (-43.2 + F.col("stop_id") * 53 % 89 / 40000).alias("lng"))
    return sequence.stay_points(e, ["vehicle", "day"], "t", "dwell", "stop_id", 150.0, 300).select("vehicle", "day", "stay", "arrive", "leave", "true_end", "events")


@query(_S + """ SELECT stop_id, prev_end, prev_place FROM (SELECT stop_id, start, store, lag("end") OVER (PARTITION BY vehicle ORDER BY start, stop_id) AS prev_end, lag(store) OVER (PARTITION BY vehicle ORDER BY start, stop_id) AS prev_place FROM stops WHERE kind = 'STORE') WHERE start < prev_end - 60 AND store <> prev_place""")
def overlapping_stops(spark: SparkSession, d: str) -> DataFrame:
    return sequence.overlapping(i.stops(spark, d).where("kind = 'STORE'"), ["vehicle"], "start", "end", "store", "stop_id").select("stop_id", "prev_end", "prev_place")


@query(f"""WITH RECURSIVE {i.STOPS}, p AS (SELECT vehicle, start // 86400 AS day, stop_id, start, "end" AS e, kind, -22.9e0 + (stop_id * 37 % 97) / 3e4 AS lat, -43.2e0 + (stop_id * 53 % 89) / 3e4 AS lng FROM stops),
 n AS (SELECT *, row_number() OVER (PARTITION BY vehicle, day ORDER BY start, stop_id) AS r FROM p),
 walk AS (SELECT stop_id, vehicle, day, lat, lng, r, e AS tt, true AS open, false AS grown FROM n
  UNION ALL SELECT w.stop_id, w.vehicle, w.day, w.lat, w.lng, n.r, CASE WHEN n.start >= w.tt AND g.good THEN n.e ELSE w.tt END, CASE WHEN n.start < w.tt THEN w.open ELSE g.good END, w.grown OR (n.start >= w.tt AND g.good)
   FROM walk w JOIN n ON n.vehicle = w.vehicle AND n.day = w.day AND n.r = w.r + 1 AND w.open, LATERAL (SELECT n.kind = 'OUTSIDE' AND ((n.start - w.tt <= 600 AND n.e - n.start >= 900) OR (n.start - w.tt <= 1200 AND n.e - n.start >= 1800)) AND {i.haversine_sql('w.lat', 'w.lng', 'n.lat', 'n.lng')} <= 300 AS good) g)
 SELECT stop_id, max(tt) AS extended FROM walk WHERE grown GROUP BY stop_id""")
def chain_extensions(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).withColumn("day", F.floor(F.col("start") / 86400)).withColumn("lat", -22.9 + F.col("stop_id") * 37 % 97 / 30000).withColumn("lng", -43.2 + F.col("stop_id") * 53 % 89 / 30000)
    return sequence.chain_extend(s, ["vehicle", "day"], "stop_id", "start", "end", F.col("kind") == "OUTSIDE").where("extended is not null").select("stop_id", "extended")


def _trips(spark: SparkSession, d: str) -> DataFrame:
    e = i.deliveries(spark, d)
    return e.select("delivery", "vehicle", F.col("planned_at").alias("arrive"), F.floor(F.col("planned_at") / 86400).alias("day"), (F.col("delivery") * 29 % 101).alias("planned"), "lat", "lng", (F.col("delivery") % 4 != 0).alias("done"))


_TRIPS = f"WITH RECURSIVE {i.DELIVERIES}, trips AS (SELECT delivery, vehicle, planned_at AS arrive, planned_at // 86400 AS day, delivery * 29 % 101 AS planned, delivery % 4 <> 0 AS done FROM deliveries)"


@query(_TRIPS + " SELECT delivery, row_number() OVER (PARTITION BY vehicle, day ORDER BY arrive, planned) AS actual FROM trips WHERE done")
def planned_and_actual_order(spark: SparkSession, d: str) -> DataFrame:
    return sequence.ranked_against_plan(_trips(spark, d).where("done"), ["vehicle", "day"], "arrive", "planned").select("delivery", F.col("actual").cast("long").alias("actual"))


@query(_TRIPS + " SELECT delivery FROM (SELECT *, min(CASE WHEN done THEN planned END) OVER (PARTITION BY vehicle, day) AS lo, max(CASE WHEN done THEN planned END) OVER (PARTITION BY vehicle, day) AS hi FROM trips) WHERE NOT done AND planned > lo AND planned < hi")
def skipped_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return sequence.skipped(_trips(spark, d), ["vehicle", "day"], "planned", F.col("done")).select("delivery")


@query(_TRIPS + """, o AS (SELECT vehicle, day, planned, row_number() OVER (PARTITION BY vehicle, day ORDER BY arrive, planned) AS r FROM trips WHERE done),
 up(vehicle, day, r, planned, n) AS (SELECT vehicle, day, r, planned, 1 FROM o UNION SELECT o.vehicle, o.day, o.r, o.planned, up.n + 1 FROM up JOIN o ON o.vehicle = up.vehicle AND o.day = up.day AND o.r > up.r AND o.planned >= up.planned),
 dn(vehicle, day, r, planned, n) AS (SELECT vehicle, day, r, planned, 1 FROM o UNION SELECT o.vehicle, o.day, o.r, o.planned, dn.n + 1 FROM dn JOIN o ON o.vehicle = dn.vehicle AND o.day = dn.day AND o.r > dn.r AND o.planned <= dn.planned),
 a AS (SELECT vehicle, day, max(n) AS u FROM up GROUP BY ALL), b AS (SELECT vehicle, day, max(n) AS v FROM dn GROUP BY ALL), c AS (SELECT vehicle, day, count(*) AS stops FROM o GROUP BY ALL)
 SELECT vehicle, day, stops, CAST(u AS BIGINT) AS in_order, stops >= 4 AND 10 * v >= 7 * stops AND v > u AS reversed FROM c JOIN a USING (vehicle, day) JOIN b USING (vehicle, day)""")
def order_conformity(spark: SparkSession, d: str) -> DataFrame:
    done = sequence.ranked_against_plan(_trips(spark, d).where("done"), ["vehicle", "day"], "arrive", "planned")
    return kernels.order_conformity(done, ["vehicle", "day"], "actual", "planned")


@query()
def route_lengths(spark: SparkSession, d: str) -> DataFrame:
    done = sequence.ranked_against_plan(_trips(spark, d).where("done"), ["vehicle", "day"], "arrive", "planned")
    return kernels.route_lengths(done, ["vehicle", "day"], "actual", "planned")


@query()
def dense_spots(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).where("store is not null").withColumn("day", F.floor(F.col("start") / 7200))
    return kernels.dense_spots(s.withColumn("lat", -22.9 + F.col("stop_id") % 11 / 3000).withColumn("lng", -43.2 + F.col("stop_id") % 7 / 3000), ["vehicle"], "day", 150.0)


@query()
def united_stays(spark: SparkSession, d: str) -> DataFrame:
    s = i.stops(spark, d).withColumn("day", F.floor(F.col("start") / 86400)).withColumn("lat", -22.9 + F.col("stop_id") % 11 / 3000)
    return kernels.united_intervals(s.withColumn("lng", F.lit(-43.2)), ["vehicle", "day"], "start", "end", 500.0)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs (delivery, stop) of a vehicle and day with their distance as cost."""
    from waymark.functions.geo import haversine
    from waymark.operators.joins import range_join

    s = i.stops(spark, d).where("kind = 'STORE'").select("stop_id", "vehicle", F.floor(F.col("start") / 86400).alias("day"), F.col("lat").alias("lat_r"), F.col("lng").alias("lng_r"))
    plan = i.deliveries(spark, d).withColumn("day", F.floor(F.col("planned_at") / 86400))
    return range_join(plan, s, ["vehicle", "day"], 3000.0, haversine).select("vehicle", "day", "delivery", "stop_id", F.floor("dist").cast("double").alias("cost"))


@query()
def optimal_assignment(spark: SparkSession, d: str) -> DataFrame:
    return kernels.assign(_pairs(spark, d), ["vehicle", "day"], "delivery", "stop_id", "cost")


@query()
def greedy_assignment(spark: SparkSession, d: str) -> DataFrame:
    return kernels.greedy_pairs(_pairs(spark, d), ["vehicle", "day"], "delivery", "stop_id", "cost")


@query(f"""WITH {i.ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY network, store, day ORDER BY CAST(status = 'delivered' AS INT) DESC, entry) AS r FROM entries)
 SELECT network, store, day, max(CASE WHEN r = 1 THEN entry END) AS first, max(CASE WHEN r = 2 THEN entry END) AS second, greatest(count(*) - 2, 0) AS rest FROM r GROUP BY network, store, day""")
def two_slots(spark: SparkSession, d: str) -> DataFrame:
    return sequence.two_slots(i.entries(spark, d), ["network", "store", "day"], [(F.col("status") == "delivered").cast("int").desc(), F.col("entry")], "entry")
