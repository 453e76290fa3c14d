"""Corpus pipeline: line cleaning, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of ``documents``; run() writes each result to the shared folder and
reads it again for the next stage. Every stage takes nulls in any column, empty texts and texts of
any length, repeated rows, empty tables and further columns of any name, and keeps all columns of what it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import read_table, small, stored


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def line_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines; null and empty texts have too few words and go."""
    from waymark.llm.quality import cleaned

    return _recounted(cleaned(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learnt from the labels of those that came this far. Without labels all stay."""
    from waymark.llm.toxicity import without_toxic

    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; rows without a doc_id all stay.

    Of rows that repeat a doc_id one stays, chosen by a hash of the row.
    """
    from waymark.llm.neardup import near_duplicates as grouped

    groups = grouped(docs)
    gone = groups.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = stored(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "again")
    n = again.count()
    if not n:
        return left
    row = F.struct(*[left[c] for c in left.columns])
    repeated = left.join(small(again, n), "doc_id", "left_semi").select("doc_id", row.alias("row"), F.xxhash64(row).alias("hash"))
    one = repeated.groupBy("doc_id").agg(F.min_by("row", "hash").alias("row"))
    return left.join(small(again, n), "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("row.*").select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; a null text stays null."""
    from waymark.llm.pii import redacted

    return _recounted(redacted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of 2048; a null text is packed as an empty one."""
    import public_tokenizers

    from waymark.llm.packing import packed

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("line_quality", line_quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Learnt models and packing have no SQL form; tests hold each stage against its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that every stage keeps."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
