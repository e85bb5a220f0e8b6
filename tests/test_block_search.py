"""Exact search by blocks: the results of all pairs, which no join makes."""

import numpy as np
import pytest

from gaitspark.operators import retrieval as R

from .test_cells import plan


def vectors(n=300, d=12, seed=4):
    z = np.random.default_rng(seed).normal(size=(n, d))
    z[n // 2 :] = z[: n - n // 2]
    return z


def brute(q, x, k, metric):
    if metric == "cosine":
        d = 1 - (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None])
    else:
        d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    return {(i, r + 1): j for i in range(len(q)) for r, j in enumerate([j for j in np.lexsort((np.arange(len(x)), d[i].round(9))) if j != i][:k])}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_few_queries_meet_blocks(spark, metric, monkeypatch):
    for name, value in (("GRID_ROWS", 70), ("SOME", 16), ("PAIRS", 1000)):
        monkeypatch.setattr(R, name, value)
    z = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)] + [(900, [float("nan")] * 12), (901, None)], "id long, z array<double>")
    got = R.knn(df.where("id < 90"), df, 5, metric)
    assert {(r.query_id, r["rank"]): r.id for r in got.collect()} == {k: v for k, v in brute(z, z, 5, metric).items() if k[0] < 90}
    assert "NestedLoop" not in plan(got) and "zip_with" not in plan(got)


def test_all_against_all_where_cells_leave_out_nothing(spark, monkeypatch):
    for name, value in (("GRID_ROWS", 120), ("QUERY_BLOCK", 40)):
        monkeypatch.setattr(R, name, value)
    z = np.random.default_rng(2).normal(size=(300, 40))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>")
    got = R.all_knn(df, 4)
    assert {(r.query_id, r["rank"]): r.id for r in got.collect()} == brute(z, z, 4, "euclidean")
    assert "_p" in plan(got) and "turn" not in plan(got)


def test_many_excluded_ids_leave_enough(spark):
    z = vectors(60, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>")
    order = brute(z, z, 59, "euclidean")
    gone = spark.createDataFrame([(0, int(order[0, r])) for r in range(1, 21)], "query_id long, id long")
    got = R.knn_distinct(df.where("id = 0"), df, 3, exclude=gone)
    assert [r.id for r in got.orderBy("rank").collect()] == [order[0, r] for r in (21, 22, 23)]
