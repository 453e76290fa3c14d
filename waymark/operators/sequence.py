"""Sequence operators over ordered rows of a key: gaps, sessions, islands, paths, chains.

What windows can say is said with windows. Where a step depends on the state left by the one
before, an expression folds over the ordered rows of one key and day, a group of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import haversine


def gap_sessions(df: DataFrame, keys: list[str], start: str, end: str, gap: int, tie: str) -> DataFrame:
    """``session``: a new one begins ``gap`` seconds or more after the row before ended."""
    w = Window.partitionBy(*keys).orderBy(start, tie)
    fresh = (F.col(start) - F.lag(end).over(w) >= gap).cast("int")
    return df.withColumn("_new", F.coalesce(fresh, F.lit(0))).withColumn("session", F.sum("_new").over(w)).drop("_new")


def longest_per_session(df: DataFrame, keys: list[str], start: str, end: str, gap: int, demoted: Column, tie: str) -> DataFrame:
    """One row per session: the longest that is not ``demoted``, the earliest of equals."""
    from waymark.operators.joins import best_per

    return best_per(gap_sessions(df, keys, start, end, gap, tie), [*keys, "session"], [demoted.cast("int"), (F.col(end) - F.col(start)).desc(), F.col(start), F.col(tie)])


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``run``: consecutive rows with an equal value (null equals null) share a number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return df.withColumn("_new", F.when(F.row_number().over(w) == 1, 0).otherwise(changed)).withColumn("run", F.sum("_new").over(w)).drop("_new")


def longest_run(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per key and value the longest of its runs (earliest of equals): n, first, last of ``order[0]``."""
    from waymark.operators.joins import best_per

    t = order[0]
    got = runs(df, keys, order, value).where(F.col(value).isNotNull()).groupBy(*keys, value, "run").agg(F.count("*").alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))
    return best_per(got, [*keys, value], [F.col("n").desc(), F.col("run")]).drop("run")


def islands(df: DataFrame, keys: list[str], slot: str) -> DataFrame:
    """Adjacent slot numbers merged: first_slot, last_slot, n."""
    w = Window.partitionBy(*keys).orderBy(slot)
    got = df.select(*keys, slot).distinct().withColumn("_island", F.col(slot) - F.row_number().over(w))
    return got.groupBy(*keys, "_island").agg(F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"), F.count("*").alias("n")).drop("_island")


def last_before(df: DataFrame, keys: list[str], order: list[str], value: Column, alias: str) -> DataFrame:
    """The largest ``value`` among earlier rows (null where it doesn't apply)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(alias, F.max(value).over(w))


def first_after(df: DataFrame, keys: list[str], order: list[str], value: Column, alias: str) -> DataFrame:
    """The smallest ``value`` among later rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(alias, F.min(value).over(w))


def return_after_last(df: DataFrame, keys: list[str], start: str, end: str, home: Column, least: int) -> DataFrame:
    """Per key the first stay at home of ``least`` seconds or more after the last stop elsewhere ended."""
    last = F.max(F.when(~home, F.col(end))).over(Window.partitionBy(*keys))
    got = df.withColumn("_last", last)
    back = F.min(F.when(home & (F.col(start) >= F.col("_last")) & (F.col(end) - F.col(start) >= least), F.col(start)))
    return got.groupBy(*keys).agg(F.max("_last").alias("last_out"), back.alias("back_at"))


def impossible_jumps(df: DataFrame, keys: list[str], start: str, end: str, tie: str, metres: float, kmh: float, minutes: int) -> DataFrame:
    """Gaps: pairs of successive stops too far apart for the time between them.

    Kept: over ``metres``, faster than ``kmh`` (or in no time at all), and ``minutes`` at least
    from start to start. Columns: keys, gap_start, gap_end, minutes, jump_m and both points.
    """
    w = Window.partitionBy(*keys).orderBy(start, tie)
    got = df.where("lat is not null and lng is not null").withColumn("_n", F.lead(F.struct(F.col(start).alias("t"), "lat", "lng")).over(w)).where("_n is not null")
    jump = haversine(F.col("lat"), F.col("lng"), F.col("_n.lat"), F.col("_n.lng"))
    got = got.withColumn("jump_m", jump).withColumn("_hours", F.greatest(F.lit(0), F.col("_n.t") - F.coalesce(F.col(end), F.col(start))) / 3600)
    got = got.where((F.col("jump_m") > metres) & ((F.col("_hours") == 0) | (F.col("jump_m") / 1000 > kmh * F.col("_hours"))))
    out = got.select(*keys, F.col(start).alias("gap_start"), F.col("_n.t").alias("gap_end"), ((F.col("_n.t") - F.col(start)) / 60).alias("minutes"), "jump_m", F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"), F.col("_n.lat").alias("lat_b"), F.col("_n.lng").alias("lng_b"))
    return out.where(F.col("minutes") >= minutes)


def fitting_gap(points: DataFrame, gaps: DataFrame, on: list[str], key: list[str], first: bool, detour_m: float = 3000.0, kmh: float = 40.0, stay: int = 5) -> DataFrame:
    """A gap that a visit to each point fits into: near the straight line, or feasible in the time.

    ``first`` takes the earliest gap, else the one with the smallest detour. Points: lat, lng.
    """
    from waymark.operators.joins import best_per

    met = points.join(gaps, on)
    there = haversine(F.col("lat_a"), F.col("lng_a"), F.col("lat"), F.col("lng"))
    back = haversine(F.col("lat"), F.col("lng"), F.col("lat_b"), F.col("lng_b"))
    met = met.withColumn("_way", there + back).withColumn("detour_m", F.col("_way") - F.col("jump_m"))
    met = met.where((F.col("detour_m") <= detour_m) | (F.col("_way") / 1000 / kmh * 60 + stay <= F.col("minutes"))).drop("_way")
    return best_per(met, key, [F.col("gap_start")] if first else [F.col("detour_m"), F.col("gap_start")])


def without_covered(gaps: DataFrame, outages: DataFrame, on: list[str], percent: int, bucket: int) -> DataFrame:
    """Gaps (gap_start, gap_end) of which outages (start_r, end_r) cover less than ``percent``."""
    from waymark.operators.joins import overlap_join

    met = overlap_join(gaps.withColumn("start", F.col("gap_start")).withColumn("end", F.col("gap_end")), outages, on, bucket)
    covered = met.groupBy(*on, "gap_start", "gap_end").agg(F.sum("overlap").alias("_covered"))
    out = gaps.join(covered, [*on, "gap_start", "gap_end"], "left")
    return out.where(100 * F.coalesce("_covered", F.lit(0)) < percent * (F.col("gap_end") - F.col("gap_start"))).drop("_covered")


def path_length(df: DataFrame, keys: list[str], order: list[str], distance=haversine) -> DataFrame:
    """``metres`` along the ordered points of each key; null with fewer than two."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = distance(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    return df.where("lat is not null and lng is not null").withColumn("_step", step).groupBy(*keys).agg(F.sum("_step").alias("metres"), F.count("*").alias("points"))


def overlapping(df: DataFrame, keys: list[str], start: str, end: str, place: str, tie: str, slack: int = 60) -> DataFrame:
    """Rows that begin over ``slack`` seconds before the row before them, elsewhere, has ended."""
    w = Window.partitionBy(*keys).orderBy(start, tie)
    got = df.withColumn("prev_end", F.lag(end).over(w)).withColumn("prev_place", F.lag(place).over(w))
    return got.where((F.col(start) < F.col("prev_end") - slack) & (F.col(place) != F.col("prev_place")))


def alone_of_code(df: DataFrame, keys: list[str], code: str, odd: Column) -> DataFrame:
    """Without odd rows that are the only one of their code."""
    n = F.count("*").over(Window.partitionBy(*keys, code))
    return df.withColumn("_n", n).where(~(odd & (F.col("_n") == 1) & F.col(code).isNotNull())).drop("_n")


def _ordered(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows"))


def stay_points(df: DataFrame, keys: list[str], t: str, dwell: str, tie: str, radius_m: float = 150.0, least: int = 0) -> DataFrame:
    """Stays: successive events within ``radius_m`` of the FIRST event of the open stay.

    Columns: keys, stay (from 0), arrive, leave (arrival at the next stay, or the end), true_end
    (last event plus its dwell seconds), events, lat, lng. Stays of fewer than ``least`` seconds go.
    ``keys`` must bound the group (a vehicle and a day).
    """
    fields = [t, tie, "lat", "lng", dwell]
    kind = dict(df.dtypes)
    shape = f"array<struct<arrive:{kind[t]},last:{kind[t]},dwell:{kind[dwell]},lat:{kind['lat']},lng:{kind['lng']},events:bigint>>"
    rows = _ordered(df.where(f"{t} is not null and lat is not null and lng is not null"), keys, fields)

    def step(acc: Column, e: Column) -> Column:
        top = F.try_element_at(acc, F.lit(-1))
        near = F.coalesce(haversine(top["lat"], top["lng"], e["lat"], e["lng"]) <= radius_m, F.lit(False))
        longer = F.struct(top["arrive"].alias("arrive"), e[t].alias("last"), e[dwell].alias("dwell"), top["lat"].alias("lat"), top["lng"].alias("lng"), (top["events"] + 1).alias("events"))
        fresh = F.struct(e[t].alias("arrive"), e[t].alias("last"), e[dwell].alias("dwell"), e["lat"].alias("lat"), e["lng"].alias("lng"), F.lit(1).cast("long").alias("events"))
        return F.when(near, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(fresh)))

    found = rows.select(*keys, F.aggregate("_rows", F.from_json(F.lit("[]"), shape), step).alias("_stays"))
    each = found.select(*keys, "_stays", F.posexplode("_stays").alias("stay", "s"))
    after = F.try_element_at(F.col("_stays"), F.col("stay") + 2)["arrive"]
    true_end = F.col("s.last") + F.coalesce(F.col("s.dwell"), F.lit(0))
    out = each.select(*keys, "stay", F.col("s.arrive").alias("arrive"), F.coalesce(after, true_end).alias("leave"), true_end.alias("true_end"), F.col("s.events").alias("events"), F.col("s.lat").alias("lat"), F.col("s.lng").alias("lng"))
    return out.where(F.col("leave") - F.col("arrive") >= least)


def chain_extend(df: DataFrame, keys: list[str], key: str, start: str, end: str, step_kind: Column, radius_m: float = 300.0, backward: bool = False) -> DataFrame:
    """``extended``: the leave time of each stop stretched over the stops that follow on.

    A follower counts if ``step_kind`` holds, it lies within the radius of the stop itself, and it
    begins within 10 minutes and lasts 15, or within 20 and lasts 30. The first that fails ends
    the chain; null where nothing follows. ``backward`` stretches the arrival over the stops
    before, which must have ended when the chain begins. A key's stops are listed once and all
    their chains follow from that list; ``keys`` must bound the group.
    """
    rows = df.withColumn("_step", step_kind)
    fields = {"s": start, "k": key, "e": end, "ok": "_step", "lat": "lat", "lng": "lng"}
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(n) for n, c in fields.items()]))).alias("_all"))

    def chain(own: Column, others: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            gap, stay = (acc["at"] - p["e"] if backward else p["s"] - acc["at"]), p["e"] - p["s"]
            timely = ((gap <= 600) & (stay >= 900)) | ((gap <= 1200) & (stay >= 1800))
            near = haversine(own["lat"], own["lng"], p["lat"], p["lng"]) <= radius_m
            good = F.coalesce(acc["open"] & p["ok"] & timely & near & (gap >= 0), F.lit(False))
            skip = F.lit(False) if backward else acc["open"] & (gap < 0)
            new = F.struct(F.when(good, p["s"] if backward else p["e"]).otherwise(acc["at"]).alias("at"), good.alias("open"), (acc["grown"] | good).alias("grown"))
            return F.when(skip, acc).otherwise(new)

        zero = F.struct((own["s"] if backward else own["e"]).alias("at"), F.lit(True).alias("open"), F.lit(False).alias("grown"))
        return F.aggregate(others, zero, step, lambda a: F.when(a["grown"], a["at"]))

    every = F.reverse("_all") if backward else F.col("_all")
    found = listed.withColumn("_all", every).withColumn("_chains", F.transform("_all", lambda own, i: F.struct(own["k"].alias(key), chain(own, F.slice("_all", i + 2, F.size("_all"))).alias("extended"))))
    return df.join(found.select(*keys, F.explode("_chains").alias("_c")).select(*keys, "_c.*"), [*keys, key], "left")


def ranked_against_plan(done: DataFrame, trip: list[str], arrive: str, planned: str) -> DataFrame:
    """``actual``: place by arrival within the trip, equal arrivals in planned order."""
    return done.withColumn("actual", F.row_number().over(Window.partitionBy(*trip).orderBy(arrive, planned)))


def skipped(rows: DataFrame, trip: list[str], planned: str, done: Column) -> DataFrame:
    """Pending rows whose planned place lies between the smallest and largest done ones."""
    w = Window.partitionBy(*trip)
    low, high = F.min(F.when(done, F.col(planned))).over(w), F.max(F.when(done, F.col(planned))).over(w)
    got = rows.withColumn("_low", low).withColumn("_high", high)
    return got.where(~done & (F.col(planned) > F.col("_low")) & (F.col(planned) < F.col("_high"))).drop("_low", "_high")


def two_slots(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """The first two rows of each key side by side: first, second, and how many more there are."""
    got = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return got.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("_r") == 2, F.col(value))).alias("second"), F.greatest(F.count("*") - 2, F.lit(0)).alias("rest"))
