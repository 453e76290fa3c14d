import numpy as np

from waymark.llm import ann


def exact(rows, queries, k):
    out = {}
    for qid, q in queries.items():
        score = [(-(np.dot(q, v) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(q, q))), i) for i, v in rows.items() if i != qid]
        out[qid] = [i for _, i in sorted(score)[:k]]
    return out


def test_recall_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = vectors.where("vec_id % 50 = 0")
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    want = exact(rows, {r.vec_id: rows[r.vec_id] for r in asked.collect()}, 5)
    got = {}
    for r in ann.neighbours(vectors, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        x, y = rows[r.query_id], rows[r.vec_id]
        assert abs(r.score - np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y))) < 1e-12
    recall = sum(len(set(got[q]) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))
    print("recall", recall)
    assert recall >= 0.9 and all(len(x) == 5 for x in got.values())


def test_robust_pruning_keeps_diverse_edges():
    unit = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0, 1]], np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert ann.robust_prune(unit, 0, np.array([1, 2, 3, -1, 0])).tolist() == [1, 3]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [1.0, None]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 1.0]), (4, [1.0, 0.0, 0.0]), (3, [0.0, 1.0]), (5, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id as rank", "vec_id as near", "vec_id as shard")
    got = [tuple(r) for r in ann.neighbours(vectors, vectors.where("vec_id % 50 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert ann.neighbours(vectors.limit(0), vectors).count() == 0 and ann.neighbours(vectors, vectors.limit(0)).count() == 0
