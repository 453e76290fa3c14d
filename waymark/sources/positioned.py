"""Records from positioned text: items of (page, x, y, text) become lines, columns by the page's own heading, and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_lines(items: DataFrame, page: list[str], tolerance: float) -> DataFrame:
    """``items`` with line (from 1 down the page) and line_y (its highest item); a gap in y of more than ``tolerance`` begins a line.

    Items without a place or text are left out; texts are trimmed, blank ones are left out as well.
    """
    rows = items.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("x is not null and y is not null and text <> ''")
    down = Window.partitionBy(*page).orderBy(F.col("y").desc(), "x", "text")
    begins = F.coalesce((F.lag("y").over(down) - F.col("y") > tolerance).cast("long"), F.lit(1))
    rows = rows.withColumn("_begins", begins).withColumn("line", F.sum("_begins").over(down)).drop("_begins")
    return rows.withColumn("line_y", F.max("y").over(Window.partitionBy(*page, "line")))


def column_bands(labels: dict[str, str], places: dict[str, Column], default: dict[str, tuple[float, float]], missing: int) -> Column:
    """Array of (name, low, high): a column reaches half way to the labels found beside its own.

    A column without a label keeps its default band; with more than ``missing`` labels lost all do.
    """
    names = list(labels)
    known = sum((places[n].isNotNull().cast("int") for n in names), F.lit(0))
    bands = []
    for k, n in enumerate(names):
        left, right = [places[m] for m in reversed(names[:k])], [places[m] for m in names[k + 1 :]]
        low = F.coalesce((places[n] + F.coalesce(*left)) / 2, F.lit(0.0)) if left else F.lit(0.0)
        high = F.coalesce((places[n] + F.coalesce(*right)) / 2, F.lit(9999.0)) if right else F.lit(9999.0)
        own = places[n].isNotNull() & (known >= len(names) - missing)
        bands.append(F.struct(F.lit(n).alias("name"), F.when(own, low).otherwise(float(default[n][0])).alias("low"), F.when(own, high).otherwise(float(default[n][1])).alias("high")))
    return F.array(*bands)


def records(items: DataFrame, page: list[str], labels: dict[str, str], default: dict[str, tuple[float, float]], anchor: tuple[str, str], wrapped: list[str], extra_labels: str | None = None, tolerance: float = 2.0, missing: int = 2) -> DataFrame:
    """One row per record: ``page``, record (line of its anchor), and a text for each column of ``labels`` (name: pattern of its heading).

    A line with a heading is no data; the first label of each column gives its place on that page. A line in whose
    ``anchor`` column (name, pattern) an item matches begins a record, and each other line belongs to the nearest anchor,
    in the middle to both. ``wrapped`` columns join their items over all lines of the record, the others are
    the first item on the anchor's line, so that a footer doesn't run into them. Missing texts are empty; a page without
    an anchor has no record. An item in two bands (possible with default ones) is read in both. All windows are by
    page, and share one shuffle.
    """
    rows = text_lines(items.select(*page, "x", "y", "text"), page, tolerance)
    whole = Window.partitionBy(*page)
    for n, pattern in labels.items():
        first = F.min(F.when(F.col("text").rlike(pattern), F.struct("line", "x"))).over(whole)
        rows = rows.withColumn(f"_at_{n}", first["x"])
    rows = rows.withColumn("_bands", column_bands(labels, {n: F.col(f"_at_{n}") for n in labels}, default, missing)).drop(*[f"_at_{n}" for n in labels])
    heading = F.col("text").rlike("|".join(f"(?:{p})" for p in [*labels.values(), *([extra_labels] if extra_labels else [])]))
    rows = rows.withColumn("_heading", F.max(heading).over(Window.partitionBy(*page, "line"))).where("not _heading").drop("_heading")
    held = F.filter("_bands", lambda b: (F.col("x") >= b["low"]) & (F.col("x") < b["high"]))
    rows = rows.withColumn("_in", F.transform(held, lambda b: b["name"])).drop("_bands")
    begins = F.array_contains("_in", anchor[0]) & F.col("text").rlike(anchor[1])
    rows = rows.withColumn("_begins", begins).withColumn("_anchor", F.max("_begins").over(Window.partitionBy(*page, "line")))
    here = F.when(F.col("_anchor"), F.struct("line", F.col("line_y").alias("y")))
    above = Window.partitionBy(*page).orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    below = Window.partitionBy(*page).orderBy(F.col("line").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_up", F.last(here, ignorenulls=True).over(above)).withColumn("_down", F.last(here, ignorenulls=True).over(below))
    up, down = F.col("_up.y") - F.col("line_y"), F.col("line_y") - F.col("_down.y")
    near = F.array(F.when(down.isNull() | (up <= down), F.col("_up.line")), F.when(up.isNull() | (down <= up), F.col("_down.line")))
    rows = rows.withColumn("record", F.explode(F.array_distinct(F.array_compact(near)))).withColumn("_name", F.explode("_in"))
    place, out = F.struct("line", "x", "text"), []
    for n in labels:
        mine = F.col("_name") == n
        if n in wrapped:
            got = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(mine, place))), lambda p: p["text"]), " ")
        else:
            item = mine & (F.col("line") == F.col("record"))
            got = F.coalesce(F.min(F.when(item & F.col("_begins") if n == anchor[0] else item, place))["text"], F.lit(""))
        out.append(got.alias(n))
    return rows.groupBy(*page, "record").agg(*out)
