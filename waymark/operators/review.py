"""Review operators: queues, suggestions, searches, approvals, plan changes and pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import haversine
from waymark.functions.text import name_key, similarity
from waymark.operators.joins import best_per, interval_join, latest, many, near_places
from waymark.sources.store import kept


def search(df: DataFrame, columns: list[str], text: str, least: int = 3, most: int = 30, order: list[str] | None = None) -> DataFrame:
    """Rows of which a column holds the text, without case and accents; none for fewer than ``least`` letters or digits.

    The limit is the feature: a result page.
    """
    asked = "".join(c for c in text if c.isalnum())
    if len(asked) < least:
        return df.limit(0)
    needle = name_key(F.lit(text))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(name_key(F.col(c).cast("string")), needle), F.lit(False))
    return df.where(hit).orderBy(*(order or columns)).limit(most)


def review_queue(df: DataFrame, category: str, categories: list[str], order: list[Column], resolved: str, resolved_at: str, key: list[str]) -> DataFrame:
    """``list`` open or resolved and ``place`` in it: open rows by category and ``order``, resolved ones newest first.

    Places are counted within a list and category, so no task sorts everything.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, categories)), F.col(category)), F.lit(0))
    got = df.withColumn("list", F.when(F.col(resolved), "resolved").otherwise("open")).withColumn("category_rank", F.when(F.col(resolved), 0).otherwise(F.when(rank == 0, len(categories) + 1).otherwise(rank)))
    newest = F.when(F.col(resolved), F.col(resolved_at)).desc_nulls_last()
    w = Window.partitionBy("list", "category_rank").orderBy(newest, *order, *map(F.col, key))
    return got.withColumn("place", F.row_number().over(w))


def suggestions(stops: DataFrame, stores: DataFrame, key: list[str], name: str, name_r: str, radius_m: float = 500.0, k: int = 5, least: float = 0.5) -> DataFrame:
    """Up to ``k`` stores near each stop: score is the larger of name and distance likeness, plus 0.05 if both are good.

    Stops of one name and place have the same stores, so these are looked for once.
    """
    order, same = [F.col("score").desc(), F.col("dist"), F.col(name_r)], ["_name", "_lat", "_lng"]
    around = near_places(stops, stores, [], radius_m, haversine).groupBy(F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).agg(F.collect_list(F.struct("lat_r", "lng_r", "dist")).alias("_around"))
    asked = stops.select(F.col(name).alias("_name"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).repartition(many(stops), *same).distinct().withColumn("_key", name_key(F.col("_name")))
    met = asked.join(kept(around, "around"), ["_lat", "_lng"]).select(*same, "_key", F.inline("_around")).join(stores.withColumn("_key_r", name_key(F.col(name_r))), ["lat_r", "lng_r"])
    by_name, by_place = similarity(F.col("_key"), F.col("_key_r")), 1 - F.col("dist") / radius_m
    met = met.where((by_place >= least) | (by_name >= least)).withColumn("_likeness", by_name)
    score = F.greatest(F.col("_likeness"), by_place) + F.when((F.col("_likeness") >= least) & (by_place >= least), 0.05).otherwise(0.0)
    best = best_per(met.withColumn("score", score).drop("_key", "_key_r", "_likeness"), same, order, k)
    mine = F.col(name).eqNullSafe(F.col("_name")) & (F.col("lat") == F.col("_lat")) & (F.col("lng") == F.col("_lng"))
    return best_per(stops.join(best, mine).drop(*same), key, order, k, "place")


def approved(aliases: DataFrame, votes: DataFrame, key: list[str], step: float = 0.1, auto: int = 5) -> DataFrame:
    """Aliases after approvals: confidence grows by ``step`` a vote up to 1; ``auto`` votes make it automatic.

    A vote counts only if it names the alias's present version, which it raises by one.
    """
    n = votes.join(aliases.select(*key, "version"), [*key, "version"]).groupBy(*key).agg(F.count("*").alias("_n"))
    out = aliases.join(n, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    out = out.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + step * F.col("_n"))).withColumn("votes", F.col("votes") + F.col("_n"))
    return out.withColumn("automatic", F.col("votes") >= auto).withColumn("version", F.col("version") + (F.col("_n") > 0).cast("long")).drop("_n")


def changed_plan(plan: DataFrame, changes: DataFrame, key: list[str], column: str, order: list[str]) -> DataFrame:
    """The plan with ``column`` replaced by each key's latest change; changes of unknown keys become new lines."""
    last = latest(changes, key, order).select(*key, F.col(column).alias("_new"))
    both = plan.withColumn("_old", F.lit(True)).join(last, key, "full_outer")
    return both.withColumn(column, F.coalesce("_new", column)).withColumn("added", F.col("_old").isNull()).drop("_new", "_old")


def paired_in_order(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], order_r: list[str]) -> DataFrame:
    """Rows of both sides paired first with first, second with second, for keys with equally many on both."""
    def numbered(df: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys)
        return df.withColumn("_r", F.row_number().over(w.orderBy(*by))).withColumn("_n", F.count("*").over(w))

    return numbered(left, order).join(numbered(right, order_r), [*keys, "_r", "_n"]).drop("_n", "_r")


def near_in_time_and_space(done: DataFrame, stops: DataFrame, on: list[str], key: list[str], seconds: int, metres: float) -> DataFrame:
    """The nearest stop of each sign-off (t, lat, lng) within seconds of its span and within metres.

    ``stops``: stop_id, start, end, lat_r, lng_r.
    """
    wide = stops.withColumn("_low", F.col("start") - seconds).withColumn("_high", F.col("end") + seconds)
    met = interval_join(done, wide, on, "t", "_low", "_high", 3600)
    met = met.withColumn("dist", haversine(F.col("lat"), F.col("lng"), F.col("lat_r"), F.col("lng_r"))).where(F.col("dist") <= metres)
    return best_per(met, key, [F.col("dist"), F.col("stop_id")]).drop("_low", "_high")


def failing_clients(df: DataFrame, client: str, day: str, failed: Column, days: int) -> DataFrame:
    """Clients that failed on at least ``days`` distinct days."""
    got = df.groupBy(client).agg(F.countDistinct(F.when(failed, F.col(day))).alias("failed_days"), F.countDistinct(day).alias("days"))
    return got.where(F.col("failed_days") >= days)
