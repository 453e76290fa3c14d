import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.common import odd_documents
from waymark.llm.components import components
from waymark.llm.neardup import near_duplicates

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in (text or "").translate({i: i + 32 for i in range(65, 91)}) + " ":
        if c in SPACES:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: ({len(x) for x in sets[d]}, find(d)) for d in ids}


def corpus():
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(900)]
    rows = []
    base = [rng.choice(pool) for _ in range(120)]
    for _ in range(130):  # a large group of copies, some of which are too far from all others
        copy = [rng.choice(pool) if rng.random() < rng.choice((0.005, 0.02, 0.05)) else w for w in base]
        rows.append(" ".join(copy))
    for _ in range(30):
        text = [rng.choice(pool) for _ in range(rng.randint(6, 80))]
        rows += [" ".join(text), " ".join(text), " ".join(text[:-1]).upper()]
    rows += ["", None, "   \n", "one two", "one  two", "ONE two", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for d, (n, c) in want.items():
        assert {got[d].n_shingles} == n and got[d].component_id == c and got[d].kept == (d == c), d


def test_large_group_around_the_threshold(spark):
    """3,000 near copies of one text, of which many are no links of each other, against all pairs by matrix product."""
    rng = np.random.RandomState(3)
    base = rng.randint(0, 5000, 150)
    rows = []
    for k in range(3000):
        text = base.copy()
        at = rng.rand(len(base)) < rng.choice([0.004, 0.012, 0.02])
        text[at] = rng.randint(0, 5000, at.sum())
        rows.append((k, " ".join(f"w{w}" for w in text)))
    sets = [sorted(shingles(t)) for _, t in rows]
    counts = Counter(s for x in sets for s in x)
    code = {s: i for i, s in enumerate(sorted(s for s, n in counts.items() if n > 1))}  # others are in no intersection
    both = np.zeros((len(rows), len(rows)), np.float32)
    held = [np.array([code[s] for s in x if s in code], int) for x in sets]
    for low in range(0, len(code), 4096):
        part = np.zeros((len(rows), 4096), np.float32)
        for i, x in enumerate(held):
            part[i, x[(x >= low) & (x < low + 4096)] - low] = 1
        both += part @ part.T
    size = np.array([len(x) for x in sets])
    link = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(link, True)
    want = np.arange(len(rows))
    while True:
        least = np.where(link, want[None, :], len(rows)).min(1)
        if (least == want).all():
            break
        want = least
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == dict(enumerate(want.tolist()))
    assert 1 < len(set(got.values())) < 1500


def test_repeated_ids_with_other_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, one), (5, two), (5, one), (7, one + " c"), (9, two + " c"), (11, "d " * 9)]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11)}


def test_odd_rows(spark):
    got = near_duplicates(odd_documents(spark)).collect()
    assert len(got) == odd_documents(spark).count()
    assert all(r.component_id is None and r.kept is None for r in got if r.doc_id is None)
    assert all(r.n_shingles == 0 for r in got if r.doc_id in (1, 2))
    empty = near_duplicates(odd_documents(spark).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_components_of_a_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    edges = edges.unionByName(spark.createDataFrame([(99, 99), (None, 3), (71, 70), (70, 71)], "src long, dst long"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(60)}, 99: 99, 70: 70, 71: 70}
