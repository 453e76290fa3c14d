import zlib
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.common import odd_documents
from waymark.llm import sharding
from waymark.llm.sharding import sharded


def check(docs, got, shards):
    sizes = Counter(r.shard for r in got)
    every = [sizes.get(s, 0) for s in range(shards)]
    assert len(got) == docs.count() and max(every) - min(every) <= 1
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))


def test_laws_on_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharded(docs).collect()
    check(docs, got, 24)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    groups = {}
    for r in got:
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None
        groups.setdefault(texts[r.doc_id], []).append(r.shard)
    several = [x for x in groups.values() if 1 < len(x) <= 20]
    together = sum(len(set(x)) == 1 for x in several)
    assert together >= 0.9 * len(several), (together, len(several))


def test_a_group_larger_than_a_shard_is_spread(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "if(id < 100, 'same', concat('t', id)) as text")
    got = sharded(docs, 10).collect()
    check(docs, got, 10)
    assert len({r.shard for r in got if r.doc_id < 100}) <= 5


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check(docs, sharded(docs, 4).collect(), 4)
    assert sharded(docs.limit(0)).count() == 0


def test_salted_groups_give_the_same_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"k{i % 7}", 3) for i in range(200)], "doc_id long, text_key string, size long")
    groups = rows.select("text_key").distinct().where("text_key <> 'k3'").withColumn("more", F.length("text_key"))
    plain = [sorted(map(tuple, sharding._with_group(rows, g, 6, how).collect())) for how, g in (("inner", groups), ("left_anti", groups.select("text_key")))]
    monkeypatch.setattr(sharding, "BROADCAST_GROUPS", 1)
    salted = [sorted(map(tuple, sharding._with_group(rows, g, 6, how).collect())) for how, g in (("inner", groups), ("left_anti", groups.select("text_key")))]
    assert plain == salted and len(plain[0]) + len(plain[1]) == 200


def test_fewer_cut_edges_than_by_hash(spark):
    """Links between a copy and the first of its group that lie in two shards, against a hash and the fewest possible."""
    rows = [(i, f"text {i % 60}" if i < 1200 else f"own {i}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.shard for r in sharding.sharded(docs, 8).collect()}
    hashed = {r.doc_id: r.shard for r in sharding._rows(docs, 8).select("doc_id", "shard").collect()}
    cut = lambda shard: sum(shard[i] != shard[i % 60] for i in range(60, 1200))
    assert cut(got) <= 0.25 * cut(hashed)  # none need be cut: a group of 20 fits a shard of 300


def test_groups_of_all_sizes_stay_together(spark):
    """One group of a third of the rows, groups from 0.4 to 2 shards and small ones: each touches one shard more than it needs at most."""
    capacity, sizes = 500, [4000, 1000, 700, 600, 450, 300, 200, 200, 200, 40, 40, 30, 20, *[7] * 60]
    texts = [f"g{i}" for i, n in enumerate(sizes) for _ in range(n)]
    texts += [f"own {i}" for i in range(12_000 - len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = sharded(docs).collect()
    check(docs, got, 24)
    shards = {}
    for r in got:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    for i, n in enumerate(sizes):
        assert len(shards[f"g{i}"]) <= -(-n // capacity) + (n > capacity), (n, len(shards[f"g{i}"]))


def test_only_linked_documents(spark):
    """Nothing unlinked fills the gaps: counts stay even, and few groups are cut."""
    docs = spark.range(2400).selectExpr("id as doc_id", "concat('t', id % 150) as text")
    got = sharded(docs, 10).collect()
    check(docs, got, 10)
    shards = {}
    for r in got:
        shards.setdefault(r.doc_id % 150, set()).add(r.shard)
    assert sum(len(x) > 1 for x in shards.values()) <= 10
