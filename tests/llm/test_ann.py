import numpy as np
from pyspark.sql import functions as F

from seqloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)


def nearest(x, ids, q, k):
    s = (x * x[q]).sum(1)
    s[ids == ids[q]] = -np.inf
    return np.lexsort((ids, -s))[: min(k, (ids != ids[q]).sum())], s


def test_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 400 * 24)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 25 * 24)
    r = np.random.default_rng(1)
    x = np.vstack([r.standard_normal((900, 24)), np.repeat(r.standard_normal((5, 24)), 40, 0) + 0.01 * r.standard_normal((200, 24)), np.tile(r.standard_normal(24), (100, 1))]).astype(np.float32)
    x[::3] *= 2.5
    ids = np.arange(len(x))
    got = ann.search(table(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)]), F.col("vec_id") % 20 == 0, 20).toPandas()
    hit = total = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        best, s = nearest(x.astype(float), ids, q, 20)
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, s[g.vec_id], rtol=0, atol=1e-9)
        assert all(a > b or (a == b and i < j) for a, b, i, j in zip(g.score, g.score[1:], g.vec_id, g.vec_id[1:]))
        hit += len(set(best) & set(g.vec_id))
        total += 20
    assert len(got) == 20 * 60 and hit / total >= 0.95


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 2.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [])]
    got = ann.search(table(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 7, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0), (20, 3, 7, 0.0)]


def test_empty(spark):
    assert ann.search(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_of_one_id_are_queries_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    got = ann.search(table(spark, rows), F.col("vec_id") % 20 == 0, 1).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 2.0), (0, 1, 2, 3.0)]


def test_op5_against_exact_search(spark, tmp_path):
    from seqloom.llm.queries import QUERIES

    r = np.random.default_rng(4)
    x = r.standard_normal((1500, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    ids = np.arange(len(x))
    table(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)]).selectExpr("*", "vec_id as rank", "score as x").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op5_ann"](spark, str(tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "double"]
    hit = 0
    for q, g in got.toPandas().groupby("query_id"):
        best, s = nearest(x.astype(float), ids, q, 20)
        assert np.allclose(g.score, s[g.vec_id], rtol=0, atol=1e-9) and sorted(g["rank"]) == list(range(1, 21))
        hit += len(set(best) & set(g.vec_id))
    assert hit >= 0.95 * 75 * 20
