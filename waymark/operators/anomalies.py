"""Data-quality rules: each takes DataFrames and gives rows of (code, severity, subject, detail).

``routes``: route_id, vehicle, store, planned, left_base, arrive, leave, kind, dist_m, label.
``stops``: stop_id, vehicle, kind, store, start, end, lat, lng.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import haversine
from waymark.functions.text import hamming
from waymark.functions.time import DAY
from waymark.operators.joins import nearest
from waymark.operators.sequence import overlapping

SEVERITY = {"01": "HIGH", "02": "LOW", "03": "MED", "04": "HIGH", "05": "MED", "06": "HIGH", "07": "HIGH", "08": "MED", "10": "LOW", "11": "LOW", "12": "MED", "13": "MED", "14": "HIGH", "15": "HIGH", "16": "MED", "17": "MED"}


def _found(df: DataFrame, code: str, subject: str, detail: Column | None = None) -> DataFrame:
    text = F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))
    return df.select(F.lit(f"ANOM-{code}").alias("code"), F.lit(SEVERITY[code]).alias("severity"), F.col(subject).cast("string").alias("subject"), text.alias("detail"))


def unmatched_plan(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """01: a planned vehicle without any stop, or a route without a matched one."""
    gps = stops.select("vehicle", F.lit(True).alias("_gps")).distinct()
    got = routes.join(gps, "vehicle", "left").where("_gps is null or arrive is null")
    return _found(got, "01", "route_id", F.when(F.col("_gps").isNull(), "no stops").otherwise("no match"))


def unplanned(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """02: a vehicle with stops but no plan."""
    return _found(stops.select("vehicle").distinct().join(routes.select("vehicle"), "vehicle", "left_anti"), "02", "vehicle")


def outside_without_store(stops: DataFrame, seconds: int = 600) -> DataFrame:
    """03: a stop outside of base that is long enough and has no store."""
    return _found(stops.where((F.col("kind") == "OUTSIDE") & F.col("store").isNull() & (F.col("end") - F.col("start") >= seconds)), "03", "stop_id")


def bad_times(routes: DataFrame) -> DataFrame:
    """04 and 12: left before arriving; left in the instant of arriving."""
    return _found(routes.where("leave < arrive"), "04", "route_id").unionByName(_found(routes.where("leave = arrive"), "12", "route_id"))


def wrong_stop_count(routes: DataFrame, vehicle_day: list[str]) -> DataFrame:
    """05: a plan line for one store (no ``+`` or ``/`` in its label) whose vehicle has another number of matched stops."""
    n = routes.groupBy(*vehicle_day).agg(F.count("arrive").alias("_n"))
    return _found(routes.where(~F.col("label").rlike("[+/]")).join(n, vehicle_day).where("_n <> 1"), "05", "route_id", F.col("_n"))


def departures(routes: DataFrame) -> DataFrame:
    """06 and 07: matched without a departure from base; arrived before it."""
    return _found(routes.where("arrive is not null and left_base is null"), "06", "route_id").unionByName(_found(routes.where("arrive < left_base"), "07", "route_id"))


def long_stay(routes: DataFrame, minutes: int = 240) -> DataFrame:
    """08: stayed over the limit."""
    stay = (F.col("leave") - F.col("arrive")) / 60
    return _found(routes.where(stay > minutes), "08", "route_id", F.floor(stay))


def unresolved_store(routes: DataFrame, pattern: str) -> DataFrame:
    """10: no store although the label is of a network that needs one."""
    return _found(routes.where(F.col("store").isNull() & F.col("label").rlike(pattern)), "10", "route_id")


def odd_departure(routes: DataFrame, first: int, last: int) -> DataFrame:
    """11: left base outside the window of minutes; a window whose end is before its start spans midnight."""
    minute = F.floor(F.pmod(F.col("left_base"), F.lit(DAY)) / 60)
    inside = minute.between(first, last) if first <= last else (minute >= first) | (minute <= last)
    return _found(routes.where(~inside), "11", "route_id", minute)


def far_credit(routes: DataFrame, metres: float = 2000.0) -> DataFrame:
    """13: credited with a stop too far from its store."""
    return _found(routes.where(F.col("dist_m") > metres), "13", "route_id", F.floor("dist_m"))


def two_places_at_once(stops: DataFrame, keys: list[str]) -> DataFrame:
    """14: a vehicle in two stores at a time for over a minute."""
    return _found(overlapping(stops.where("kind = 'STORE'"), keys, "start", "end", "store", "stop_id"), "14", "stop_id", F.col("prev_place"))


def near_plates(planned: DataFrame, seen: DataFrame, plate: str) -> DataFrame:
    """15: a planned plate without stops that differs in one character from one that has some.

    Joined on the plate with one character taken out at the same place, so that only such pairs meet.
    """
    holes = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substring(c, F.lit(1), i - 1), F.lit("_"), F.substring(c, i + 1, F.length(c))))
    left = planned.select(plate).where(F.length(plate) > 0).distinct().join(seen.select(plate), plate, "left_anti")
    one = left.withColumn("_h", F.explode(holes(F.col(plate))))
    two = seen.where(F.length(plate) > 0).select(F.col(plate).alias("other")).distinct().withColumn("_h", F.explode(holes(F.col("other"))))
    met = one.join(two, "_h").where(hamming(F.col(plate), F.col("other")) == 1).groupBy(plate).agg(F.min("other").alias("other"))
    return _found(met, "15", plate, F.col("other"))


def hardly_moved(stops: DataFrame, keys: list[str], before: int = 5 * 3600) -> DataFrame:
    """16: one operational stop at most, and nothing after the early hour."""
    got = stops.groupBy(*keys).agg(F.count_if(F.col("kind").isin("STORE", "OUTSIDE")).alias("_n"), F.max(F.pmod(F.col("start"), F.lit(DAY))).alias("_last"))
    return _found(got.where((F.col("_n") <= 1) & (F.col("_last") < before)), "16", "vehicle", F.col("_n"))


def hidden_stop(stops: DataFrame, stores: DataFrame, on: list[str], metres: float = 80.0) -> DataFrame:
    """17: a stop taken for a false exit that lies near a store. ``stores``: store_id, lat_r, lng_r."""
    got = nearest(stops.where("kind = 'FAKE_EXIT'"), stores, ["stop_id"], on, metres, haversine, ["store_id"])
    return _found(got, "17", "stop_id", F.col("store_id"))


def collected(*rules: DataFrame) -> DataFrame:
    """All findings."""
    return reduce(DataFrame.unionByName, rules)


def described(findings: DataFrame, texts: dict[str, str]) -> DataFrame:
    """One row per subject with the texts of its codes, in order, and whether one is of high severity."""
    names = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
    got = findings.groupBy("subject").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.bool_or(F.col("severity") == "HIGH").alias("high"))
    said = F.array_join(F.transform("codes", lambda c: F.coalesce(F.try_element_at(names, c), c)), "; ")
    return got.withColumn("text", said).select("subject", F.array_join("codes", ",").alias("codes"), "high", "text")
