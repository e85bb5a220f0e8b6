"""Models, retrieval and statistics against numpy and simple truths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitspark.operators import bootstrap as B
from gaitspark.operators import hierarchy as H
from gaitspark.operators import models as M
from gaitspark.operators import retrieval as R
from gaitspark.operators import stats as S
from gaitspark.sources import newest_version, read_model, save_index, save_model


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(5).normal(size=(150, 5)) @ np.diag([3, 2, 1, 0.5, 0.1])
    return x, spark.createDataFrame([(i, f"e{i}", r.tolist(), "ab"[i % 2], "human") for i, r in enumerate(x)], "id long, episode_id string, z array<double>, taxon string, label_source string")


def test_pca_like_svd(cloud):
    x, df = cloud
    model = M.fit_pca(df, 3)
    s = (x - x.mean(0)) / (x.std(0) + 1e-9)
    _, sv, vt = np.linalg.svd(s, full_matrices=False)
    assert np.allclose(np.abs(model.components), np.abs(vt[:3]), atol=1e-8)
    assert np.allclose(model.explained, (sv**2 / (sv**2).sum())[:3])
    got = {r.episode_id: r.p for r in df.select("episode_id", model.transform(F.col("z")).alias("p")).collect()}
    want = s @ model.components.T
    assert all(np.allclose(got[f"e{i}"], want[i], atol=1e-8) for i in range(len(x)))


def test_wide_components_like_svd(spark):
    """More dimensions than a matrix of cross products would be made for."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6)) * [9, 7, 5, 4, 3, 2] @ rng.normal(size=(6, 1500)) + rng.normal(size=(120, 1500)) + 1000
    x[:, 7] = 3.0
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "z array<double>").repartition(7)
    model = M.fit_pca(df, 3)
    s = (x - x.mean(0)) / (x.std(0) + 1e-9)
    _, sv, vt = np.linalg.svd(s, full_matrices=False)
    assert np.allclose(np.abs(model.components), np.abs(vt[:3]), atol=1e-6)
    assert np.allclose(model.explained, (sv**2 / (sv**2).sum())[:3], rtol=1e-6) and np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, x.std(0) + 1e-9)


def test_wide_path_on_few_dimensions(cloud):
    x, df = cloud
    a, b = M.fit_pca(df, 3), M.fit_pca(df, 3, narrow=0)
    assert np.allclose(a.components, b.components, atol=1e-6) and np.allclose(a.explained, b.explained) and np.allclose(a.mean, b.mean)
    assert not len(M.fit_pca(df.where("id < 0"), 3).components) and len(M.fit_pca(df.limit(1), 3, narrow=0).components) == 1


def test_models_round_trip(spark, cloud, tmp_path):
    model = M.fit_pca(cloud[1], 2)
    save_model(spark, str(tmp_path / "m"), "a", model)
    assert read_model(spark, str(tmp_path / "m"), "a").checksum() == model.checksum()
    save_index(cloud[1], str(tmp_path / "i"), "0002")
    save_index(cloud[1].limit(3), str(tmp_path / "i"), "0010")
    assert newest_version(spark, str(tmp_path / "i")).count() == 3


def test_kmeans_is_a_fixed_point(cloud, spark):
    x, df = cloud
    centre, rounds = M.kmeans(df, 4, 100)
    near = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
    assert rounds < 100 and all(np.allclose(centre[k], x[near == k].mean(0)) for k in range(4) if (near == k).any())
    got = {r.episode_id: r.motif for r in M.assign(df.select("episode_id", "z"), M.centre_table(spark, centre)).collect()}
    assert [got[f"e{i}"] for i in range(len(x))] == near.tolist()


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_all_neighbors_like_brute_force(cloud, metric):
    x, df = cloud
    a = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if metric == "euclidean" else 1 - a @ a.T
    np.fill_diagonal(d, np.inf)
    for blocks in (1, 3):
        got = {}
        for r in R.all_knn(df, 4, metric, blocks).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.id
        assert all([got[i][k] for k in range(1, 5)] == np.argsort(d[i], kind="stable")[:4].tolist() for i in range(len(x)))
    few = {(r.query_id, r["rank"]): r.id for r in R.knn(df.where("id < 5"), df, 4, metric).collect()}
    assert all(few[i, 1] == int(d[i].argmin()) for i in range(5))


def test_identical_neighbors_all_agree(cloud):
    near = R.all_knn(cloud[1], 3)
    assert R.agreement(near, near).agg(F.min("jaccard")).first()[0] == 1.0
    assert R.kept_share(near, near, 3).agg(F.min("consistency")).first()[0] == 1.0


def test_novelty(spark, cloud):
    far = spark.createDataFrame([(1000, [50.0] * 5), (0, cloud[0][0].tolist())], "id long, z array<double>")
    got = {r.query_id: r.ood for r in R.ood_flags(far, cloud[1]).collect()}
    assert got[1000] and not got[0]


def test_overlap_limits(spark):
    rows = [("a", float(i)) for i in range(100)] + [("b", float(i)) for i in range(100)]
    same = spark.createDataFrame(rows, "side string, value double").withColumn("k", F.lit(1))
    assert S.overlap(same, ["k"]).first().overlap == pytest.approx(1.0)
    apart = same.withColumn("value", F.when(F.col("side") == "b", F.col("value") + 1000).otherwise(F.col("value")))
    assert S.overlap(apart, ["k"]).first().overlap == pytest.approx(0.0)
    assert S.overlap(same.where("side = 'a'"), ["k"]).first().overlap is None


def test_wasserstein_of_a_shift(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("b", i + 7.5) for i in range(50)], "side string, value double").withColumn("k", F.lit(1))
    assert S.wasserstein(df, ["k"]).first().w1 == pytest.approx(7.5)


def test_rank_test_values():
    assert S.u_pvalue(3, 3, 0, 0) == pytest.approx(0.1)
    assert S.u_pvalue(5, 5, 12.5, 0) == pytest.approx(1.0, abs=0.2)
    assert S.u_pvalue(2, 2, 0, 0) == pytest.approx(1 / 3)
    n = 30
    z = (450 - 200 - 0.5) / math.sqrt(n * n * (2 * n + 1) / 12)
    assert S.u_pvalue(n, n, 200, 0) == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_bootstrap(spark):
    rows = [(s, f"{s}{v}", f"{s}{v}x", float(v)) for s in "AB" for v in range(10)]
    df = spark.createDataFrame(rows, "site string, session string, video string, value double")
    assert H.auto_level(df) == "site" and H.auto_level(df.where("site = 'A'")) == "session"
    r = H.bootstrap_mean(df, "value", F.col("session")).first()
    assert r.lo < r.estimate == 4.5 < r.hi and r.clusters == 20
    g = B.bootstrap(df, {"mean": B.Mean("value")}, "session", 40).first()
    assert g.lo < 4.5 < g.hi
    assert H.counts(df).where("level = 0").first().n == 20



def test_ranges_change_no_rank_and_no_distance(spark):
    """Values with ties, dimensions of very different size, an empty side."""
    r = np.random.default_rng(8)
    rows = [(d, "ab"[int(r.integers(2))] if d != "one" else "a", float(np.round(r.normal(), 1 if d == "tied" else 6))) for d, n in (("tied", 300), ("free", 200), ("one", 20), ("few", 3)) for _ in range(n)]
    df = spark.createDataFrame(rows, "dim string, side string, value double")
    for f in (S.rank_sums, S.wasserstein):
        a, b = ({x["dim"]: tuple(x)[1:] for x in f(df, ["dim"], ranges=n).collect()} for n in (1, 7))
        assert a.keys() == b.keys() and all(np.allclose(np.array(a[k], float), np.array(b[k], float)) for k in a)


def test_the_largest_key_chooses_the_ranges(spark, monkeypatch):
    rows = [("big", "ab"[i % 2], float(i * 7 % 40)) for i in range(90)] + [("small", "a", 1.0), ("small", "b", 2.0)]
    df = spark.createDataFrame(rows, "dim string, side string, value double")
    one = {f: sorted(map(str, f(df, ["dim"]).collect())) for f in (S.rank_sums, S.wasserstein)}
    monkeypatch.setattr(S, "SORTED", 9)
    assert S.stretches(df.groupBy("dim", "value").count(), ["dim"]) == 5
    round_ = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    for f in one:
        assert round_(f(df, ["dim"])) == round_(f(df, ["dim"], ranges=1))
