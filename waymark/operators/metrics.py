"""Aggregations: definitive rates, means over clock times, rankings, histograms, periods, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.time import rounded
from waymark.operators.joins import best_per


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; null where the whole is 0."""
    return rounded(100 * part / F.nullif(whole, F.lit(0)))


def definitive_rate(df: DataFrame, keys: list[str], done: Column, failed: Column) -> DataFrame:
    """Per key: total, done, failed, rate = done / (done + failed) in whole percent (0 without either).

    Rows that are neither count in the total only.
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    got = df.groupBy(*keys).agg(F.count("*").alias("total"), n(done).alias("done"), n(failed).alias("failed"))
    return got.withColumn("rate", F.coalesce(percent(F.col("done"), F.col("done") + F.col("failed")), F.lit(0)))


def mean_minutes(minutes: Column, where: Column) -> Column:
    """Aggregate: mean of known minutes where the condition holds, rounded; null without any."""
    return rounded(F.avg(F.when(where, minutes)))


def dense_histogram(df: DataFrame, bucket: Column, size: int, name: str) -> DataFrame:
    """Counts of every bucket 0 .. size - 1, zero where there is none."""
    spark = df.sparkSession
    counted = df.select(bucket.cast("long").alias(name)).where(F.col(name).between(0, size - 1)).groupBy(name).agg(F.count("*").alias("n"))
    return spark.range(size).withColumnRenamed("id", name).join(counted, name, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of a total order (a top-k, not a global sort)."""
    return df.orderBy(*order).limit(k)


def worst_recurring(df: DataFrame, key: list[str], day: str, rate: str, goal: float, last: int = 5, times: int = 3) -> DataFrame:
    """Keys below the goal on ``times`` or more of their ``last`` rated days."""
    recent = best_per(df.where(F.col(rate).isNotNull()), key, [F.col(day).desc()], last)
    got = recent.groupBy(*key).agg(F.count_if(F.col(rate) < goal).alias("below"), F.count("*").alias("days"))
    return got.where(F.col("below") >= times)


def by_folded_name(df: DataFrame, name: str, folded: Column, measures: list[Column]) -> DataFrame:
    """Groups whose spellings fold to one key; shown under the commonest spelling, ties alphabetical."""
    rows = df.withColumn("_key", folded)
    counted = rows.groupBy("_key", name).agg(F.count("*").alias("_n"))
    shown = best_per(counted, ["_key"], [F.col("_n").desc(), F.col(name)]).select("_key", F.col(name).alias("shown"))
    return rows.groupBy("_key").agg(*measures).join(shown, "_key").withColumnRenamed("_key", "key")


def all_rows(df: DataFrame, keys: list[str], holds: Column) -> DataFrame:
    """Keys all of whose rows satisfy the condition."""
    return df.groupBy(*keys).agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("_all")).where("_all").drop("_all")


def melted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (keys, metric, value): one row per other column that is not null."""
    rest = [c for c in df.columns if c not in keys]
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in rest])
    return wide.unpivot(keys, rest, "metric", "value").where("value is not null")


def consensus_points(df: DataFrame, keys: list[str], radius_m: float = 200.0) -> DataFrame:
    """Median point of each key, then the median of the points within the radius of it; n of those."""
    from waymark.functions.geo import haversine

    mid = df.groupBy(*keys).agg(F.percentile("lat", 0.5).alias("_lat"), F.percentile("lng", 0.5).alias("_lng"))
    near = df.join(mid, keys).where(haversine(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")) <= radius_m)
    return near.groupBy(*keys).agg(F.percentile("lat", 0.5).alias("lat"), F.percentile("lng", 0.5).alias("lng"), F.count("*").alias("n"))


def error_figures(df: DataFrame, keys: list[str], error: Column, tolerance: float) -> DataFrame:
    """Coverage and errors against a truth: n, found, median, nearest-rank 90th percentile, share within tolerance."""
    rows = df.withColumn("_e", F.abs(error))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count("_e").alias("found"),
        F.percentile("_e", 0.5).alias("median"),
        F.expr("percentile_disc(0.9) within group (order by _e)").alias("p90"),
        percent(F.count_if(F.col("_e") <= tolerance), F.count("_e")).alias("within"),
    )


def slot_outages(slots: DataFrame, slot: str, key: str, total: str, late: str, share: int = 50, key_share: int = 30) -> tuple[DataFrame, DataFrame]:
    """(outages, faulty): slots in which ``share`` percent of keys read late only; keys with over ``key_share`` percent late readings."""
    alive = slots.where(F.col(total) > 0)
    by_slot = alive.groupBy(slot).agg(F.count("*").alias("keys"), F.count_if(F.col(late) == F.col(total)).alias("all_late"))
    by_key = alive.groupBy(key).agg(F.sum(total).alias("total"), F.sum(late).alias("late"))
    return by_slot.where(100 * F.col("all_late") >= share * F.col("keys")), by_key.where(100 * F.col("late") > key_share * F.col("total"))


def guarded(df: DataFrame, flagged: Column, percent_most: int, least: int) -> DataFrame:
    """Flagged rows, or none of them if they are over ``percent_most`` percent of at least ``least`` rows.

    The two counts are an aggregate of one row that is joined back.
    """
    share = df.agg(F.count("*").alias("_n"), F.count_if(flagged).alias("_f"))
    return df.where(flagged).join(F.broadcast(share)).where((F.col("_n") < least) | (100 * F.col("_f") <= percent_most * F.col("_n"))).drop("_n", "_f")


def spread(df: DataFrame, keys: list[str], limit_m: float) -> DataFrame:
    """Keys of which two points lie over ``limit_m`` apart, with the largest distance, diameter_m.

    ``keys`` must bound the group (a load); points meet in blocks of rows.
    """
    import numpy as np
    import pandas as pd

    from waymark.operators.kernels import metres

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        points = rows[["lat", "lng"]].drop_duplicates().to_numpy(float)
        a, b = points.T
        most = max(float(metres(a[i : i + 256, None], b[i : i + 256, None], a[None], b[None]).max()) for i in range(0, len(a), 256))
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "diameter_m": np.array([most])})

    kinds = dict(df.dtypes)
    got = df.select(*keys, "lat", "lng").where("lat is not null and lng is not null").groupBy(*keys)
    return got.applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", diameter_m double").where(F.col("diameter_m") > limit_m)


def partial_day_totals(days: DataFrame, partial: Column, measures: list[str]) -> DataFrame:
    """Totals over complete days only, with the number of days of either kind."""
    out = [F.sum(F.when(~partial, F.col(m))).alias(m) for m in measures]
    return days.agg(F.count("*").alias("days"), F.count_if(~partial).alias("complete"), *out)


def map_sums(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sum of map<string, number> columns by map key."""
    return df.select(*keys, F.explode(column).alias("reason", "n")).groupBy(*keys, "reason").agg(F.sum("n").alias("n"))


def share_alert(df: DataFrame, keys: list[str], flagged: Column, percent_over: int) -> DataFrame:
    """Keys in which over ``percent_over`` percent of the rows are flagged."""
    got = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(flagged).alias("flagged"))
    return got.where(100 * F.col("flagged") > percent_over * F.col("n"))


def many_partners(df: DataFrame, key: str, partner: str, least: int = 2) -> DataFrame:
    """Keys with ``least`` or more distinct partners."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(partner).alias("partners")).where(F.col("partners") >= least)


def share_of_group(df: DataFrame, group: list[str], value: str, alias: str) -> DataFrame:
    """Each row's share of its group's sum, in whole percent."""
    w = Window.partitionBy(*group)
    return df.withColumn(alias, percent(F.col(value), F.sum(value).over(w)))
