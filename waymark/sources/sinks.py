"""Writers: partition replacement, grow-only merges, save-if-better, append-only logs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from waymark.operators.rowsets import larger_version
from waymark.sources.store import kept


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write the partitions that ``df`` has in place of the old ones; others stay.

    The overwrite mode is an option of this write, not a setting of the session.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows are only ever added."""
    df.write.mode("append").parquet(path)


def _present(spark: SparkSession, path: str) -> bool:
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    return files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)


def save_if_larger(df: DataFrame, path: str, by: list[str], size: str) -> None:
    """Replace a partition only by one with as many rows or more (column ``size``)."""
    spark = df.sparkSession
    if _present(spark, path):
        old = spark.read.parquet(path).join(df.select(*by).distinct(), by, "left_semi").select(*df.columns)
        df = kept(larger_version(old, df, by, size), "larger")
    replace_partitions(df, path, by)


def grow_only(df: DataFrame, path: str, by: list[str], merge) -> None:
    """Union with what is there, merged by ``merge`` (for instance united_intervals); nothing ever shrinks."""
    spark = df.sparkSession
    if _present(spark, path):
        old = spark.read.parquet(path).join(df.select(*by).distinct(), by, "left_semi").select(*df.columns)
        df = old.unionByName(df)
    replace_partitions(kept(merge(df), "grown"), path, by)


def report(df: DataFrame, path: str, tab: str | None = None) -> None:
    """CSV export; ``tab`` names a column by which files are split (a tab of a workbook each)."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(tab) if tab else writer).csv(path)


def purge(spark: SparkSession, path: str, keep: Column) -> None:
    """Rewrite a cache with the rows for which ``keep`` holds; an emptied partition goes as well."""
    old = spark.read.parquet(path)
    left = kept(old.where(keep), "purged")
    left.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
