"""Recompute of touched days: a micro-batch names its days, only those are computed again, each from all its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from waymark.sources.store import shared_path


def _numbered(schema: StructType) -> StructType:
    """``schema`` and ``batch``, as a type of its own: ``add`` on a type made from its fields would change ``schema`` as well."""
    return StructType([*schema.fields, StructField("batch", LongType())])


def _landed(spark: SparkSession, root: str, schema: StructType, number: int) -> DataFrame:
    """All rows that arrived up to a batch."""
    return spark.read.schema(_numbered(schema)).parquet(f"{root}/landed").where(F.col("batch") <= number).drop("batch")


def days_as_of(spark: SparkSession, root: str) -> DataFrame:
    """day, batch: the batch that last computed each day. Days are folders, so the table is as small as the list of them."""
    return spark.read.schema("day long, batch long").parquet(f"{root}/touched").groupBy("day").agg(F.max("batch").alias("batch"))


def current(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The result of every day as its last batch computed it; a day that came out empty has no rows."""
    return spark.read.schema(_numbered(schema)).parquet(f"{root}/results").join(F.broadcast(days_as_of(spark, root)), ["day", "batch"]).select(*schema.names)


def recomputed_days(stream: DataFrame, compute: Callable[[DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """Run a stream of rows with a long ``day`` to its end; the current results of all days.

    ``compute`` makes the results of the days in its input from all their rows, and keeps ``day``. A batch writes,
    in this order, its rows by day, the results of the days it names, and then the list of those days, which is
    what makes the results count. Each is a folder of the batch's own number, overwritten when the batch runs again,
    and reads rows up to its own batch only: a replay, also after a crash between any two of the writes, gives the same.
    Other days are neither read nor written. ``root`` names the folder of state: a driver that starts again with it
    goes on where the last one ended. Results that a later batch replaced stay for readers under way.
    Rows without a day count for none. ``day`` and ``batch`` are names of folders; the rows have no other ``batch``.
    """
    spark, schema = stream.sparkSession, stream.schema
    root = root or shared_path(spark, "days")
    result = compute(spark.createDataFrame([], schema)).schema

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # a task for each file and all days: a batch of one hot day is written by all tasks that read it
        batch.where("day is not null").write.mode("overwrite").partitionBy("day").parquet(f"{root}/landed/batch={number}")
        days = session.read.schema(schema).parquet(f"{root}/landed/batch={number}").select("day").distinct()
        days.write.mode("overwrite").parquet(f"{root}/days/{number}")
        days = session.read.schema("day long").parquet(f"{root}/days/{number}")
        # no more days than folders that the driver lists anyway; as literals they prune the folders of all others
        named = [r.day for r in days.collect()]
        rows = _landed(session, root, schema, number).where(F.col("day").isin(named))
        compute(rows).write.mode("overwrite").partitionBy("day").parquet(f"{root}/results/batch={number}")
        days.write.mode("overwrite").parquet(f"{root}/touched/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    try:
        spark.read.parquet(f"{root}/touched")
    except AnalysisException:  # there was never a batch, or none with a day
        return spark.createDataFrame([], result)
    return current(spark, root, result)
