"""Small-world graph search (operator 2)."""

from __future__ import annotations

import numpy as np
import pytest

from rollatlas.llm import graphs


def exact(rows, query, k):
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    q = vectors[query]
    cos = lambda v: float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum())))
    return sorted((-round(cos(v), 12), i) for i, v in vectors.items() if i != query and len(v) == len(q))[:k]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    points = centres[rng.integers(0, 6, 900)] + 0.7 * rng.normal(size=(900, 16))
    points[300:420] = points[300]
    return [(i, x.astype(np.float32).tolist()) for i, x in enumerate(points)]


def test_recall_scores_and_ties(spark, rows):
    df = graphs.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    index = graphs.build_index(df, shard_rows=200)
    assert index.count() > 3
    queries = df.filter("id % 50 = 0")
    found = graphs.search(index, queries, query_rows=7).collect()
    hits = 0
    for q in range(0, 900, 50):
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        want = exact(rows, q, 5)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        hits += len({i for _, i, _ in own} & {i for _, i in want})
        assert all(abs(s + dict((i, s) for s, i in exact(rows, q, 900))[i]) < 1e-9 for _, i, s in own)
        if q in (300, 350, 400):
            # Equal vectors: the smallest ids win, without the query itself.
            assert [i for _, i, _ in own] == [i for i in range(300, 307) if i != q][:5]
    assert hits >= 0.95 * 5 * 18


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [1.0, 1.0]), (None, [1.0, 0.0]), (50, [1.0, 0.0, 0.0]), (100, []), (7, [1.0, 1.0]), (8, [1e30, 1e30]),
    ]
    df = graphs.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = graphs.search(graphs.build_index(df), df.filter("id % 50 = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 7), (0, 3, 8)]
    assert found[0].score <= 1.0 + 1e-15


def test_no_vectors(spark):
    df = graphs.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert graphs.search(graphs.build_index(df), df).collect() == []


def test_double_vectors_are_scored_as_they_are(spark):
    """Differences below single precision decide, and squares beyond the range do no harm."""
    rows = [(50, [1.0, 0.0]), (1, [1.0, 3e-6]), (2, [1.0, 2e-6]), (3, [1e250, 1e244]), (4, [1e-250, 2.5e-256]), (5, [1.0, 1.0])]
    df = graphs.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = graphs.search(graphs.build_index(df), df.filter("id % 50 = 0")).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == [3, 2, 4, 1, 5]
