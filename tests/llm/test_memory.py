"""What the stages of the pipeline leave for each other in the memory of the executors' Python workers."""

import random
import tracemalloc
from types import SimpleNamespace

import public_tokenizers as P
import pyarrow as pa

from waymark.llm import common, packing, quality, tokens

WORDS = P.path("word_bpe_49k.json")


class Arrow:
    """Stands for a table; ``mapInArrow`` gives the function that a task would run."""

    columns, schema = ["doc_id", "text"], None

    def select(self, *columns):
        return self

    def mapInArrow(self, f, schema):
        return f


def block(size):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=700)) + "." for _ in range(size // 4500)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])


def peak(run, batch):
    for _ in run(iter([batch])):  # pieces are remembered from here on
        pass
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB:", most / 1e6, "rows:", rows)
    return most


def test_cutting_and_judging_a_block_take_little_memory(monkeypatch):
    """Of 4 MB, as Spark passes it on at once."""
    monkeypatch.setattr(packing, "stored", lambda f, *rest: f)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 3))
    batch = block(4_000_000)
    assert peak(packing.pieces(Arrow(), WORDS, True, 2048, 1, with_ids=False), batch) < 45e6
    assert peak(quality.cleaned(Arrow()), batch) < 45e6


def test_a_worker_forgets_the_pieces_when_other_work_begins():
    batch = block(20_000)
    held = tokens.encoder(WORDS, True)
    list(common.steps([batch], kind="ids"))
    assert tokens.encoder(WORDS, True) is held
    list(common.steps([batch]))
    assert tokens.encoder(WORDS, True) is not held


def test_no_rows_of_python_are_shipped(spark, monkeypatch):
    """A table made from a list of rows runs in Python workers of its own, beside those of the Arrow stages."""
    docs = spark.range(30).selectExpr("id as doc_id", "repeat('one two ', int(id) * 40) as text")
    table = common.stored(docs, "memory")
    monkeypatch.setattr("pyspark.SparkContext.parallelize", lambda *a, **k: 1 / 0)
    got = packing.packed(docs, WORDS)
    assert got.where("start = 0").count() == 30 and got.where("sequence_id is null or offset is null").count() == 0
    assert got.groupBy().sum("length").first()[0] == sum(80 * i + 1 for i in range(30))
    assert packing.packed(docs.limit(0), WORDS).count() == 0
    common.released(table)
    again = spark.read.parquet(table.inputFiles()[0].rsplit("/", 1)[0])
    assert again.count() == 0 and again.dtypes == table.dtypes
