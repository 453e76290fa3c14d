"""Join operators: by grid cell, by time, by priority, by n-grams, and overlays of later rows.

Distance and time conditions become equi-joins on grid cells or time buckets, so that no join
compares all pairs; a residual condition decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import DEGREE_M
from waymark.functions.text import trigrams


def _columns(row: Column, size: float) -> Column:
    """How many cells a row of latitude has around the globe, none narrower than the radius in it or beside it."""
    top = F.greatest(F.abs(row), F.abs(row + 1)) * size + size
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(top, F.lit(90.0)))) / size))


def _in_cells(points: DataFrame, lat: str, lng: str, size: float, around: int) -> DataFrame:
    """``points`` in their cell (``_row``, ``_col``), or with ``around`` = 1 in the cells around it, too; each step is a column of its own."""
    row, steps = F.floor(F.col(lat) / size), range(-around, around + 1)
    rows = points.where(f"{lat} is not null and {lng} is not null").withColumn("_row", F.explode(F.array(*[row + k for k in steps])))
    rows = rows.withColumn("_n", _columns(F.col("_row"), size)).withColumn("_at", F.floor((F.col(lng) + 180) / 360 * F.col("_n")))
    return rows.withColumn("_col", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("_at") + k, F.col("_n")) for k in steps])))).drop("_n", "_at")


def range_join(left: DataFrame, right: DataFrame, on: list[str], radius_m: float, distance) -> DataFrame:
    """Pairs of equal ``on`` within ``radius_m``: all columns of both sides and ``dist``.

    Both sides have lat and lng under names of their own (``lat``/``lng`` left, ``lat_r``/``lng_r``
    right). The right side is posted in its cell, the left in the cells around its own. A row of
    cells has as many as its latitude leaves room for and closes around the globe, so points near
    the poles and across the antimeridian meet as well; points without coordinates meet nothing.
    """
    size = radius_m / (DEGREE_M * 0.99)
    met = _in_cells(left, "lat", "lng", size, 1).join(_in_cells(right, "lat_r", "lng_r", size, 0), [*on, "_row", "_col"]).drop("_row", "_col")
    return met.withColumn("dist", distance(F.col("lat"), F.col("lng"), F.col("lat_r"), F.col("lng_r"))).where(F.col("dist") <= radius_m)


def near_places(left: DataFrame, right: DataFrame, on: list[str], radius_m: float, distance) -> DataFrame:
    """Different places of both sides within the radius: on, lat, lng, lat_r, lng_r, dist. However many rows share a place, it is compared once."""
    return range_join(left.select(*on, "lat", "lng").distinct(), right.select(*on, "lat_r", "lng_r").distinct(), on, radius_m, distance)


def covered_points(points: DataFrame, visitors: DataFrame, on: list[str], keys: list[str], visitor: str, point: str, radius_m: float, distance) -> DataFrame:
    """(keys, visitor, covered): how many points of each group a visitor came near; a point has one place in its group.

    Points and visitors aren't paired. Places of points are numbered and stored with the groups that have points there, and
    the numbers around each visited place; where a visitor's rows are, they are made distinct and the points added up.
    """
    from waymark.sources.store import kept

    group = [c for c in keys if c not in on]
    held = points.groupBy(*on, *group, "lat", "lng").agg(F.countDistinct(point).alias("_n")).groupBy(*on, "lat", "lng").agg(F.collect_list(F.struct(*group, "_n")).alias("_held"))
    held = kept(held.withColumn("_place", F.monotonically_increasing_id()), "held")
    around = near_places(points, visitors, on, radius_m, distance).join(held.drop("_held"), [*on, "lat", "lng"]).groupBy(*on, "lat_r", "lng_r").agg(F.collect_list("_place").alias("_around"))
    # more tasks than usual, of whole visitors: nothing but sums is exchanged after this
    been = visitors.select(*on, visitor, "lat_r", "lng_r").repartition(many(points), visitor).distinct()
    near = been.join(kept(around, "around"), [*on, "lat_r", "lng_r"]).select(*on, visitor, F.explode("_around").alias("_place")).distinct()
    return near.join(held.select("_place", "_held"), "_place").select(*on, visitor, F.inline("_held")).groupBy(*keys, visitor).agg(F.sum("_n").alias("covered"))


def many(df: DataFrame) -> int:
    """A number of tasks for little data that much comes from; adaptive execution leaves it as it is."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def best_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key in a total order, with their rank if named."""
    place = rank or "_rank"
    out = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= k)
    return out if rank else out.drop(place)


def two_first(df: DataFrame, keys: list[str], who: str, order: list[str]) -> DataFrame:
    """Of each key the first row of its first two ``who``: whichever of them is left out, the first row of the others is here."""
    each = df.groupBy(*keys, who).agg(F.min(F.struct(*order)).alias("_first"))
    return best_per(each, keys, [F.col("_first"), F.col(who)], 2).select(*keys, who, "_first.*")


def nearest(left: DataFrame, right: DataFrame, key: list[str], on: list[str], radius_m: float, distance, tie: list[str]) -> DataFrame:
    """The nearest right row of each left row within the radius; ties by ``tie``."""
    return best_per(range_join(left, right, on, radius_m, distance), key, [F.col("dist"), *map(F.col, tie)])


def isolated(left: DataFrame, right: DataFrame, key: list[str], on: list[str], radius_m: float, distance, keep: Column | None = None) -> DataFrame:
    """Left rows that no right row (for which ``keep`` holds) lies near."""
    near = range_join(left, right, on, radius_m, distance)
    near = near if keep is None else near.where(keep)
    return left.join(near.select(*key).distinct(), key, "left_anti")


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], t: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs of equal ``on`` whose instant lies in the closed interval.

    Intervals are posted in every bucket of ``bucket`` seconds that they touch, instants in theirs.
    """
    spread = intervals.where(f"{start} is not null and {end} is not null and {start} <= {end}")
    spread = spread.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return points.withColumn("_b", F.floor(F.col(t) / bucket)).join(spread, [*on, "_b"]).where(F.col(t).between(F.col(start), F.col(end))).drop("_b")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], bucket: int) -> DataFrame:
    """Pairs of equal ``on`` whose intervals [start, end] and [start_r, end_r] share more than an instant, with ``overlap`` seconds.

    A pair is kept in the bucket where its common part begins, so it appears once.
    """
    one = left.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    two = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_r") / bucket), F.floor(F.col("end_r") / bucket))))
    begin = F.greatest("start", "start_r")
    met = one.join(two, [*on, "_b"]).where(F.floor(begin / bucket) == F.col("_b")).withColumn("overlap", F.least("end", "end_r") - begin)
    return met.where("overlap > 0").drop("_b")


def as_of(left: DataFrame, right: DataFrame, on: list[str], t: str, t_r: str, payload: list[str], tie: str, within: int | None = None) -> DataFrame:
    """Each left row with ``payload`` and ``t_r`` of the latest right row not after it (null if none).

    A union and one running window per key instead of a join: linear in the rows. Of right rows
    at one instant the largest ``tie`` counts; ``within`` bounds the age in seconds.
    """
    held = F.struct(F.col(t_r).alias(t_r), *[F.col(c) for c in payload])
    one = left.withColumn("_t", F.col(t)).withColumn("_side", F.lit(1)).withColumn("_tie", F.lit(None).cast(dict(right.dtypes)[tie]))
    two = right.select(*on, F.col(t_r).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), held.alias("_held"))
    both = one.unionByName(two, allowMissingColumns=True)
    run = Window.partitionBy(*on).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_held", ignorenulls=True).over(run)).where("_side = 1")
    fresh = F.lit(True) if within is None else F.col(t) - F.col(f"_last.{t_r}") <= within
    return both.select(*left.columns, *[F.when(fresh, F.col(f"_last.{c}")).alias(c) for c in [t_r, *payload]])


def nearest_in_time(left: DataFrame, right: DataFrame, on: list[str], key: list[str], t: str, start: str, end: str, slack: int, tie: list[str]) -> DataFrame:
    """The interval that holds each instant (latest start first), else the one with the nearest start within ``slack``."""
    wide = right.withColumn("_low", F.col(start) - slack).withColumn("_high", F.greatest(F.col(end), F.col(start) + slack))
    met = interval_join(left, wide, on, t, "_low", "_high", max(slack, 3600))
    inside = F.col(t).between(F.col(start), F.col(end))
    gap = F.abs(F.col(t) - F.col(start))
    met = met.withColumn("inside", inside).withColumn("gap", gap).where(inside | (gap <= slack))
    order = [F.col("inside").desc(), F.when(F.col("inside"), -F.col(start)).otherwise(F.col("gap")), *map(F.col, tie)]
    return best_per(met, key, order).drop("_low", "_high")


def fallback_join(left: DataFrame, key: list[str], steps: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """Left rows with ``value`` and ``via`` of the first step that finds one.

    Each step is (name, lookup, join columns); a lookup must have one ``value`` per join key.
    """
    out = left
    for name, lookup, on in steps:
        out = out.join(lookup.select(*on, F.col(value).alias(f"_{name}")), on, "left")
    found = F.coalesce(*[F.col(f"_{name}") for name, _, _ in steps])
    via = F.coalesce(*[F.when(F.col(f"_{name}").isNotNull(), F.lit(name)) for name, _, _ in steps])
    return out.withColumn(value, found).withColumn("via", via).select(*left.columns, value, "via")


def unambiguous(df: DataFrame, on: list[str], value: str) -> DataFrame:
    """One row per ``on``, only where all its rows agree on ``value``."""
    one = df.where(F.col(value).isNotNull()).groupBy(*on).agg(F.min(value).alias(value), F.max(value).alias("_other"))
    return one.where(F.col(value) == F.col("_other")).drop("_other")


def suffix_join(left: DataFrame, right: DataFrame, column: str, column_r: str, length: int) -> DataFrame:
    """Left rows with the one right row that shares the last ``length`` characters; none if several do."""
    ends = right.withColumn("_end", F.right(column_r, F.lit(length))).where(F.length(column_r) >= length)
    one = ends.groupBy("_end").agg(F.min(column_r).alias(column_r), F.countDistinct(column_r).alias("_n")).where("_n = 1").drop("_n")
    return left.where(F.length(column) >= length).withColumn("_end", F.right(column, F.lit(length))).join(one, "_end").drop("_end")


def trigram_join(left: DataFrame, right: DataFrame, name: str, name_r: str, percent: int) -> DataFrame:
    """Pairs of distinct names whose trigram sets have 100 * common >= percent * union, with ``score`` (percent, rounded down).

    Exact and without comparing all pairs: only the rarest trigrams of each name, as many as a
    match cannot avoid, are posted, and the pairs that meet are then confirmed on whole sets.
    """
    sides = []
    for df, c in ((left, name), (right, name_r)):
        sides.append(df.select(c).where(F.col(c).isNotNull()).distinct().withColumn(f"_{c}", trigrams(F.col(c))))
    posted = [s.select(c, F.size(f"_{c}").alias("n"), F.explode(f"_{c}").alias("gram")) for s, c in zip(sides, (name, name_r))]
    weight = posted[0].select("gram").unionAll(posted[1].select("gram")).groupBy("gram").agg(F.count("*").alias("held"))

    def prefix(p: DataFrame, c: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(c).orderBy("held", "gram"))
        # a match shares ceil(percent / 100 * n) grams at least; all but so many may be missed
        room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        return p.join(weight, "gram").withColumn("_place", place).where(F.col("_place") <= room).select(c, "gram")

    pairs = prefix(posted[0], name).join(prefix(posted[1], name_r), "gram").select(name, name_r).distinct()
    both = pairs.join(sides[0], name).join(sides[1], name_r)
    common = F.size(F.array_intersect(f"_{name}", f"_{name_r}"))
    union = F.size(f"_{name}") + F.size(f"_{name_r}") - common
    return both.where((union > 0) & (100 * common >= percent * union)).select(name, name_r, F.floor(100 * common / union).alias("score"))


def mismatches(left: DataFrame, right: DataFrame, on: list[str], count: str) -> DataFrame:
    """Keys on one side only or with different counts: kind is missing_right, missing_left or count."""
    one, two = left.groupBy(*on).agg(F.sum(count).alias("n_left")), right.groupBy(*on).agg(F.sum(count).alias("n_right"))
    both = one.join(two, on, "full_outer")
    kind = F.when(F.col("n_right").isNull(), "missing_right").when(F.col("n_left").isNull(), "missing_left").when(F.col("n_left") != F.col("n_right"), "count")
    return both.withColumn("kind", kind).where("kind is not null")


def without_near_repeats(kept: DataFrame, extra: DataFrame, on: list[str], key: list[str], radius_m: float, seconds: int, distance) -> DataFrame:
    """``kept`` and those rows of ``extra`` that no kept row is near in both space and time.

    Both have lat, lng and t.
    """
    other = kept.select(*on, F.col("lat").alias("lat_r"), F.col("lng").alias("lng_r"), F.col("t").alias("t_r"))
    near = range_join(extra, other, on, radius_m, distance).where(F.abs(F.col("t") - F.col("t_r")) <= seconds)
    return kept.unionByName(extra.join(near.select(*key).distinct(), key, "left_anti"))


def coverage(points: DataFrame, visitors: DataFrame, group: str, visitor: str, radius_m: float, distance, percent: int, least: int, on: list[str] | None = None) -> DataFrame:
    """(on, group, visitor, covered, total) where a visitor came near enough of a group's points.

    ``points``: group, point_id, lat, lng; ``visitors``: visitor, lat_r, lng_r. ``on``: keys of both, as the day, so that
    a cell doesn't meet all its history.
    """
    keys = [*(on or []), group]
    total = points.groupBy(*keys).agg(F.countDistinct("point_id").alias("total"))
    hit = covered_points(points, visitors, on or [], keys, visitor, "point_id", radius_m, distance)
    return hit.join(total, keys).where((F.col("covered") >= least) & (100 * F.col("covered") >= percent * F.col("total"))).select(*keys, visitor, "covered", "total")


def only_leader(ranked: DataFrame, group: list[str], score: str) -> DataFrame:
    """The top row of each group by ``score``; none where the top is shared."""
    w = Window.partitionBy(*group)
    top = ranked.withColumn("_top", F.max(score).over(w)).where(F.col(score) == F.col("_top"))
    return top.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_top", "_n")


def mutual_best(pairs: DataFrame, left: str, right: str, order: list[str]) -> DataFrame:
    """Pairs by rising ``order`` (then left, then right), each taken if both sides are still free.

    Rounds of two aggregations and two anti-joins: a pair that is the first of both its sides is
    taken, and its sides leave. Groups may have any size, and no key is gathered in one task.
    """
    from waymark.sources.store import kept

    key = F.struct(*dict.fromkeys([*order, left, right]))
    open_, found = kept(pairs, "pairs"), pairs.limit(0)
    while True:
        one = open_.groupBy(left).agg(F.min(key).alias("_k"))
        two = open_.groupBy(right).agg(F.min(key).alias("_k"))
        first = kept(one.select("_k").join(two.select("_k"), "_k").select(f"_k.{left}", f"_k.{right}"), "first")
        if first.isEmpty():
            return found
        found = found.unionByName(open_.join(first, [left, right]).select(*pairs.columns))
        open_ = kept(open_.join(first.select(left), left, "left_anti").join(first.select(right), right, "left_anti"), "pairs")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    return best_per(df, keys, [F.col(c).desc() for c in order])


def overlay(base: DataFrame, history: DataFrame, keys: list[str], order: list[str], column: str, undo: str) -> DataFrame:
    """``base`` with ``column`` replaced by the latest of ``history``, unless that says ``undo``; ``changed`` tells which."""
    last = latest(history, keys, order).select(*keys, F.col(column).alias("_new")).where(F.col("_new") != undo)
    out = base.join(last, keys, "left")
    return out.withColumn(column, F.coalesce("_new", column)).withColumn("changed", F.col("_new").isNotNull()).drop("_new")


def present_wins(base: DataFrame, override: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``column`` of the override where it has a row for the key, even if that row says null."""
    told = override.select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_told"))
    return base.join(told, keys, "left").withColumn(column, F.when(F.col("_told"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_told")


def prioritised(candidates: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Union of candidate joins, earlier lists first; the best row of each key with ``priority``."""
    tagged = [c.withColumn("priority", F.lit(i + 1)) for i, c in enumerate(candidates)]
    return best_per(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), keys, [F.col("priority"), *order])
