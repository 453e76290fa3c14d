"""Nulls, ties and empty groups of operators, on rows by hand."""

import random

from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.functions import time as clock
from waymark.operators import joins, metrics, sequence
from waymark.sources import readers, sinks
from waymark.sources.store import shared_path


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_clock_times(spark):
    gap = lambda a, b: clock.clock_gap(F.lit(a), F.lit(b))
    r = one(spark, day=gap("08:00", "09:30"), night=gap("23:30", "00:15"), bad=gap("-", "09:00"), none=gap(None, "09:00"), half=clock.rounded(F.lit(-2.5)), shift=clock.shift_of(F.lit("17:59")), no=clock.shift_of(F.lit("FOLGA")))
    assert (r.day, r.night, r.bad, r.none, r.half, r.shift, r.no) == (90, 45, None, None, -2, "afternoon", None)


def test_masked_instant_drops_the_offset(spark):
    r = one(spark, a=clock.masked_instant(F.lit("2024-01-01T10:00:00-03:00")), b=clock.masked_instant(F.lit("2024-01-01 10:00:00")), c=clock.masked_instant(F.lit("soon")))
    assert r.a == r.b == 1704103200 and r.c is None


def test_token_score(spark):
    score = lambda a, b: text.token_score(text.core_tokens(F.lit(a)), text.core_tokens(F.lit(b)))
    r = one(spark, same=score("Buzios 1", "BÚZIOS 1, Other"), clash=score("Barra I Loja 133", "Sendas Barra LJ 32"), never=score("Loja 1", "Shop 2"), typo=score("Laranjeiras", "Laranjeira"), empty=score("", "x y"))
    assert (r.same, r.clash, r.never, r.typo, r.empty) == (0, 5, None, 2, None)


def test_coordinates(spark):
    box = (-23.5, -22.0, -44.0, -42.5)
    problem = lambda a, b: geo.coordinate_problem(F.lit(a).cast("double"), F.lit(b).cast("double"), box)
    r = one(spark, ok=problem(-22.9, -43.2), none=problem(None, None), half=problem(-22.9, None), zero=problem(0, -43.2), swap=problem(-43.2, -22.9), far=problem(10, 10))
    assert tuple(r) == (None, None, "incomplete", "zero", "swapped", "outside")


def test_ties_and_nulls_in_sequences(spark):
    df = spark.createDataFrame([("v", 1, 0, 10, "a"), ("v", 2, 0, 5, None), ("v", 3, 3700, 3800, None), ("w", 4, None, None, "a")], "k string, id long, s long, e long, p string")
    got = {r.id: r.session for r in sequence.gap_sessions(df, ["k"], "s", "e", 3600, "id").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}
    assert {(r.k, r.p, r.n) for r in sequence.longest_run(df, ["k"], ["s", "id"], "p").collect()} == {("v", "a", 1), ("w", "a", 1)}
    assert sequence.gap_sessions(df.limit(0), ["k"], "s", "e", 3600, "id").count() == 0


def test_stay_points_compare_with_the_first_event(spark):
    step = 100 / 111_000
    df = spark.createDataFrame([("v", i * 600, i, i * step, 0.0, 60) for i in range(4)], "k string, t long, id long, lat double, lng double, d long")
    got = sequence.stay_points(df, ["k"], "t", "d", "id").orderBy("stay").collect()
    assert [(r.arrive, r.leave, r.true_end, r.events) for r in got] == [(0, 1200, 660, 2), (1200, 1860, 1860, 2)]


def test_range_join_equals_all_pairs(spark):
    a = spark.range(300).selectExpr("id", "-22.9 + (id * 37 % 97) / 1000 as lat", "-43.2 + (id * 53 % 89) / 1000 as lng")
    b = spark.range(300).selectExpr("id as other", "-22.9 + (id * 31 % 97) / 1000 as lat_r", "-43.2 + (id * 17 % 89) / 1000 as lng_r")
    near = geo.haversine(F.col("lat"), F.col("lng"), F.col("lat_r"), F.col("lng_r")) <= 700
    want = a.crossJoin(b).where(near)
    got = joins.range_join(a.unionByName(spark.createDataFrame([(999, None, None)], a.schema)), b, [], 700.0, geo.haversine)
    assert got.select("id", "other").exceptAll(want.select("id", "other")).count() == 0 and got.count() == want.count() > 100


def test_overlay_and_present_null(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    history = spark.createDataFrame([(1, "x", 1), (1, "undo", 2), (2, "y", 1), (2, "z", 5)], "k long, v string, t long")
    assert {(r.k, r.v, r.changed) for r in joins.overlay(base, history, ["k"], ["t"], "v", "undo").collect()} == {(1, "a", False), (2, "z", True), (3, "c", False)}
    told = spark.createDataFrame([(1, None)], "k long, v string")
    assert {(r.k, r.v) for r in joins.present_wins(base, told, ["k"], "v").collect()} == {(1, None), (2, "b"), (3, "c")}


def test_rate_without_definitive_rows(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("b", "d")], "k string, s string")
    got = {r.k: (r.total, r.rate) for r in metrics.definitive_rate(df, ["k"], F.col("s") == "d", F.col("s") == "f").collect()}
    assert got == {"a": (1, 0), "b": (2, 100)}


def test_partitions_replace_only_themselves(spark):
    path = shared_path(spark, "test")
    row = lambda d, v: spark.createDataFrame([(d, v)], "d string, v long")
    sinks.replace_partitions(row("a", 1).union(row("b", 1)), path, ["d"])
    sinks.replace_partitions(row("a", 2), path, ["d"])
    sinks.append_log(row("c", 3), path + "-log")
    sinks.append_log(row("c", 3), path + "-log")
    assert {(r.d, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}
    assert spark.read.parquet(path + "-log").count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "one.txt").write_text("MANIFEST 1\nline two\n")
    (tmp_path / "two.json").write_text('{"nf": 1, "day": "2024-01-01"}\nbroken\n')
    lines = readers.document_lines(spark, str(tmp_path), "*.txt").orderBy("line_no").collect()
    assert [r.line for r in lines] == ["MANIFEST 1", "line two"]  # a line feed at the end begins no line
    assert {r.nf for r in readers.json_records(spark, str(tmp_path / "two.json"), "nf long, day string").collect()} == {1, None}
    df = spark.createDataFrame([("12", "x"), ("y", "7")], "`Año  Uno` string, b string")
    got = readers.renamed(df, {"year": ("ano uno", "long"), "gone": ("zzz", "string")}).collect()
    assert [r.year for r in got] == [12, None] and got[0].gone is None
    name, best = readers.best_parse({"a": df.where("b = 'x'"), "b": df}, F.col("b").isNotNull())
    assert name == "b" and best.count() == 2


def test_range_join_near_poles_and_across_the_antimeridian(spark):
    rng = random.Random(8)
    points = [(rng.choice([0.0, 78.0, 89.99, 89.9999, -89.995, 45.0]) + rng.uniform(-0.004, 0.004), rng.choice([179.999, -179.999, 0.0, 90.0, -90.0]) + rng.uniform(-0.02, 0.02)) for _ in range(600)]
    points = [(max(-90.0, min(90.0, a)), (b + 180) % 360 - 180) for a, b in points]
    a = spark.createDataFrame([(k, *p) for k, p in enumerate(points[:300])], "id long, lat double, lng double")
    b = spark.createDataFrame([(k, *p) for k, p in enumerate(points[300:])], "id_r long, lat_r double, lng_r double")
    got = {(r.id, r.id_r) for r in joins.range_join(a, b, [], 1000.0, geo.haversine).collect()}
    every = a.crossJoin(b).where(geo.haversine(F.col("lat"), F.col("lng"), F.col("lat_r"), F.col("lng_r")) <= 1000).select("id", "id_r").collect()
    assert got == {(r.id, r.id_r) for r in every} and len(got) > 1000
    assert len(got) == joins.range_join(a, b, [], 1000.0, geo.haversine).count()


def test_canonical_json_tells_texts_from_structure(spark):
    from waymark.operators.rowsets import canonical_json

    rows = ['{"a":"1&b=2"}', '{"a":"1","b":"2"}', '{"b":"2","a":"1"}', '{"a":null}', '{"a":"null"}', "{}"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(canonical_json(F.col("t"))).collect()]
    assert got[1] == got[2] and len(set(got)) == 5


def test_merged_batches_go_on_after_a_restart(spark, tmp_path):
    from waymark.streaming import day

    rows, root = str(tmp_path / "rows"), f"file://{tmp_path}/state"
    merge = lambda before, batch: (batch if before is None else before.unionByName(batch)).groupBy("k").agg(F.sum("n").cast("long").alias("n"))
    put = lambda *r: spark.createDataFrame(list(r), "k string, n long").coalesce(1).write.mode("append").parquet(rows)
    run = lambda: sorted(map(tuple, day.merged_batches(day.file_stream(spark, rows, "*.parquet", "k string, n long"), "sums", merge, root).collect()))
    put()
    put(("a", 1), ("b", 2))
    put(("a", 10))
    assert run() == [("a", 11), ("b", 2)]
    assert run() == [("a", 11), ("b", 2)]  # no new batch
    put(("c", 5))
    assert run() == [("a", 11), ("b", 2), ("c", 5)]
