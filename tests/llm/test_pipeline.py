"""Each stage against its operator on what the stage before it kept."""

import corpus_pipeline as pipeline
from waymark.llm import neardup, pii, quality, toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["line_quality", "toxicity", "near_duplicates", "personal_data", "packing"]
    kept = pipeline.line_quality(spark, docs, FOLDER).cache()
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.line_quality(docs).where("kept").collect()}
    mild = pipeline.toxicity(spark, kept, FOLDER).cache()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert {r.doc_id for r in mild.collect()} == {r.doc_id for r in toxicity.scored(kept, labels).where("predicted = 0").collect()}
    single = pipeline.near_duplicates(spark, mild, FOLDER).cache()
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in neardup.near_duplicates(mild).where("kept").collect()}
    clean = pipeline.personal_data(spark, single, FOLDER).cache()
    assert clean.columns == docs.columns and clean.count() == single.count()
    found = pii.personal_data(clean).selectExpr("sum(n_email)", "sum(n_phone)").first()
    assert found[0] == 0 and found[1] == 0
    pieces = pipeline.packing(spark, clean, FOLDER)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}


def test_stages_take_odd_rows(spark):
    from tests.llm.common import odd_documents

    docs = odd_documents(spark)
    for name, stage in pipeline.STAGES:
        for part in (docs, docs.limit(0)):
            got = stage(spark, part, FOLDER)
            if name == "packing":
                assert got.where("start = 0").count() == part.count()
            else:
                assert got.columns == docs.columns and got.dtypes == docs.dtypes and got.count() <= part.count(), name


def test_repeated_ids_leave_one_row(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words than those of the first"), (None, "x"), (None, "x")]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "x"), (0, "x"), (1, "a b c d e f"), (3, "other words than those of the first")]
