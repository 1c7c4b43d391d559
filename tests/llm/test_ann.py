import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import ann as A


def brute(rows, queries, k=10):
    rows = sorted((i, np.array(v, float)) for i, v in rows)
    out = {}
    for q, v in rows:
        if q in queries:
            d = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in rows if i != q)
            out[q] = d[:k]
    return out


def test_recall_and_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = A.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0")).collect()
    data = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute(data, set(range(0, 500, 20)))
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(by) == set(want)
    hit = 0
    for q, found in by.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        hit += len({i for *_, i in found} & {i for _, i in want[q]})
    assert hit >= 0.9 * 10 * len(want)


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", 50)
    monkeypatch.setattr(A, "BLOCK_QUERIES", 1)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300, 600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = A.nearest_neighbours(df, df.where("vec_id in (400, 300)")).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [*range(301, 311), *range(300, 310)] and all(r.score == 0 for r in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (8, [], 1), (1, [0.0, 1.0], 1)]
    schema = "vec_id bigint, embedding array<float>, leaf int"
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in A.nearest_neighbours(df, df).orderBy("query_id", "rank").collect()]
    root = pytest.approx(2**0.5)
    assert got == [(0, 1, 1, root), (0, 2, 1, root), (1, 1, 0, root)]
    none = spark.createDataFrame([], schema)
    assert A.nearest_neighbours(none, none).count() == 0


def test_outliers_get_all_their_ranks(spark):
    """Groups of copies need one leaf; a query alone in a leaf still gets ten neighbours."""
    rng = np.random.default_rng(3)
    rows = [(100 * g + i, c.tolist()) for g, c in enumerate(rng.normal(size=(40, 8)) * 10) for i in range(70)]
    df = spark.createDataFrame(rows + [(90_000, [500.0] * 8)], "vec_id bigint, embedding array<double>")
    got = A.nearest_neighbours(df, df.where("vec_id = 90000 or vec_id % 100 < 5")).groupBy("query_id").count().collect()
    assert len(got) == 201 and {r["count"] for r in got} == {10}
