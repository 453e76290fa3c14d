"""Set operators: repeats, shrinkage, collisions, merges of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.joins import best_per


def canonical_json(text: Column) -> Column:
    """Canonical form of a flat JSON object: a JSON array of its keys and values in order of keys.

    Texts are escaped and a null is no text, so forms are equal just for equal objects.
    """
    entries = F.array_sort(F.map_entries(F.from_json(text, "map<string,string>")))
    return F.to_json(F.transform(entries, lambda e: F.array(e["key"], e["value"])))


def numbered_repeats(df: DataFrame, key: str, order: list[Column], alias: str) -> DataFrame:
    """``alias``: the key, with -2, -3, ... from its second row on."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_r", r).withColumn(alias, F.when(F.col("_r") == 1, F.col(key).cast("string")).otherwise(F.concat_ws("-", key, "_r"))).drop("_r")


def shrunken(old: DataFrame, new: DataFrame, group: str, key: str) -> DataFrame:
    """Groups of the old version that lost rows: lost counts keys that are nowhere in the new one."""
    return old.join(new.select(key).distinct(), key, "left_anti").groupBy(group).agg(F.count("*").alias("lost"))


def colliding(df: DataFrame, point: list[str], key: str) -> DataFrame:
    """Points that carry more than one key."""
    got = df.dropna(subset=point).groupBy(*point).agg(F.countDistinct(key).alias("n_keys"))
    return got.where(F.col("n_keys") > 1)


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Full outer merge in which parts present in the new version replace the old ones."""
    rest = [c for c in old.columns if c not in key]
    both = old.join(new.select(*key, *[F.col(c).alias(f"_{c}") for c in rest]), key, "full_outer")
    return both.select(*key, *[F.coalesce(f"_{c}", c).alias(c) for c in rest])


def larger_version(old: DataFrame, new: DataFrame, key: list[str], size: str) -> DataFrame:
    """The version of each key with more rows; the new one if equal."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return best_per(both, key, [F.col(size).desc(), F.col("_new").desc()]).drop("_new")


def arbitrated(primary: DataFrame, backup: DataFrame, key: list[str], outage: DataFrame) -> DataFrame:
    """Rows of the primary source, but of the backup for keys in outage that it covers."""
    swap = outage.select(*key).distinct().join(backup.select(*key).distinct(), key, "left_semi")
    return primary.join(swap, key, "left_anti").unionByName(backup.join(swap, key, "left_semi"))


def principal_versions(versions: DataFrame, key: list[str]) -> DataFrame:
    """The official version of each key: usable closings before published ones, newest first; ``official`` false if neither.

    Columns: usable, published, created.
    """
    rank = F.when(F.col("usable"), 1).when(F.col("published"), 2).otherwise(3)
    return best_per(versions.withColumn("_order", rank), key, [F.col("_order"), F.col("created").desc()]).withColumn("official", F.col("_order") < 3).drop("_order")


def canonical_names(df: DataFrame, catalog: DataFrame, group: str, name: str) -> DataFrame:
    """``df`` with ``canonical``: the catalogue's name of the group whose key equals the name's, null if there is none or more than one.

    ``catalog``: the group column and ``canonical``.
    """
    from waymark.functions.text import name_key

    known = catalog.select(group, name_key(F.col("canonical")).alias("_key"), "canonical").distinct()
    one = known.groupBy(group, "_key").agg(F.min("canonical").alias("canonical"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return df.withColumn("_key", name_key(F.col(name))).join(one, [group, "_key"], "left").drop("_key")
