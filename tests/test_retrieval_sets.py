"""Exclusion sets, repeated ids and agreement against plain loops."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitspark.operators import kinematics, models
from gaitspark.operators import retrieval as R
from gaitspark.plans import adapters as A
from gaitspark.schema import FEATURES
from gaitspark.session import share_package

VEC = "id long, z array<double>"


def brute(queries, index, k, excluded):
    out = {}
    for q, z in queries:
        best = {}
        for i, x in index:
            if i != q and not excluded(q, i):
                d = float(np.linalg.norm(np.array(z) - np.array(x)))
                best[i] = min(best.get(i, d), d)
        out[q] = [i for i, _ in sorted(best.items(), key=lambda e: (e[1], e[0]))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("fetched", [1_000, 3])
def test_repeats_cost_no_rank(spark, monkeypatch, fetched):
    """One id stands on a third of the rows, right where the queries are; both ways of dropping repeats."""
    monkeypatch.setattr(R, "MOST_FETCHED", fetched)
    r = np.random.default_rng(1)
    index = [(7, r.normal(0, 0.1, 3).tolist()) for _ in range(60)] + [(int(i), r.normal(0, 1, 3).tolist()) for i in r.integers(100, 140, 120)]
    queries = [(i, r.normal(0, 0.3, 3).tolist()) for i in (1, 2, 7, 105)]
    q, x = spark.createDataFrame(queries, VEC), spark.createDataFrame(index, VEC).repartition(4)
    assert found(R.knn_distinct(q, x, 5)) == brute(queries, index, 5, lambda q, i: False)
    some = spark.createDataFrame([(7,), (110,), (None,), (110,)], "id long")
    assert found(R.knn_distinct(q, x, 5, exclude=some)) == brute(queries, index, 5, lambda q, i: i in (7, 110))
    pairs = spark.createDataFrame([(1, 7), (2, 120)], "query_id long, id long")
    assert found(R.knn_distinct(q, x, 5, exclude=pairs)) == brute(queries, index, 5, lambda q, i: (q, i) in ((1, 7), (2, 120)))
    assert R.knn_distinct(q, x.where("id = 7"), 5, exclude=some).count() == 0


def test_only_known_queries_agree(spark):
    hits = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 10)], "query_id long, id long")
    other = spark.createDataFrame([(1, 11), (1, 12), (2, 10), (3, 10)], "query_id long, id long")
    flags = spark.createDataFrame([(1, False), (2, True), (3, False)], "query_id long, ood boolean")
    got = R.agreement_inside(hits, other, flags, flags.withColumn("ood", F.col("query_id") == 3)).collect()
    assert [(r.query_id, round(r.jaccard, 6)) for r in got] == [(1, round(1 / 3, 6))]


@pytest.mark.parametrize("scale, metric", [(1.0, "euclidean"), (1e5, "euclidean"), (1.0, "cosine")])
def test_rings_of_cells_like_brute_force(spark, scale, metric):
    """Copies fill whole rings, and an offset makes all norms large."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(260, 3)), np.tile(rng.normal(size=(1, 3)), (80, 1)), rng.integers(-2, 3, (60, 3))]) * scale + (3 * scale if metric == "euclidean" else 0)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, z array<double>").repartition(5)
    if metric == "cosine":
        a = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = ((a[:, None] - a[None]) ** 2).sum(2) / 2
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in R.all_knn(df, 5, metric, blocks=6, block_rows=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["dist"]))
    for i in range(len(x)):
        assert np.allclose([g[2] for g in sorted(got[i])], np.sort(d[i])[:5], rtol=1e-9, atol=1e-12 * scale)
        if metric == "euclidean":
            assert [g[1] for g in sorted(got[i])] == np.lexsort((np.arange(len(x)), d[i]))[:5].tolist()


def test_features_leave_most_blocks_out(spark):
    """Three quarters of the pairs are never measured where vectors have few degrees of freedom."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3)) @ rng.normal(size=(3, 16))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, z array<double>")
    assert R.visited_share(df, 8, blocks=40, block_rows=50) < 0.25


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_share_of_the_given_features(spark):
    share_package(spark)
    z = models.standardized(kinematics.trajectory_features(A.samples(spark, "/root/testdata/sf0.1")), tuple(FEATURES)).select(F.col("episode_id").alias("id"), F.array(*FEATURES).alias("z"))
    assert R.visited_share(z, 8, blocks=40, block_rows=40) < 0.5
