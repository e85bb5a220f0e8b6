import numpy as np
import pytest

from gaitspark.plans import catalog


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """80 vectors of which 0, 25, 50 and 75 lie close together, away from the others."""
    r = np.random.default_rng(1)
    z = r.normal(size=(80, 64))
    z[::25] = 5 + 0.01 * r.normal(size=(4, 64))
    z = z.astype(np.float32).astype(float)
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(z)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, z


def rows(spark, name, d):
    return catalog.queries()[name](spark, d).collect()


@pytest.mark.parametrize("name", ["knn_euclidean", "knn_cosine"])
def test_queries_meet_every_row(spark, vectors, name):
    d, z = vectors
    got = {(r["query_id"], r["rank"]): r["id"] for r in rows(spark, name, d)}
    u = z / np.linalg.norm(z, axis=1, keepdims=True) if name == "knn_cosine" else z
    for q in (0, 50):
        order = [i for i in np.argsort(((u - u[q]) ** 2).sum(1)) if i != q]
        assert [got[q, k + 1] for k in range(6)] == order[:6]


def test_references_are_the_whole_table(spark, vectors):
    d, z = vectors
    near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)) + np.diag([np.inf] * 80)
    got = {r["query_id"]: r for r in rows(spark, "ood_flag", d)}
    assert all(got[q]["nearest"] == pytest.approx(near[q].min(), abs=1e-5) and not got[q]["ood"] for q in (0, 50))
    assert got[0]["threshold"] == pytest.approx(np.quantile(near.min(1), 0.95), abs=1e-5)
    assert sum(r["n"] for r in rows(spark, "taxa_ranking", d)) == 80
    assert sum(r["n"] for r in rows(spark, "motif_occupancy", d)) == 80
    assert sorted(r["episode_id"] for r in rows(spark, "kmeans_assign", d)) == list(range(80))
    assert {r["pos"]: r["mean"] for r in rows(spark, "cloud_mean_median", d)} == pytest.approx(dict(enumerate(z.mean(0))), abs=1e-5)
    centres = np.stack([z[m::8].mean(0) for m in range(8)])
    hits = {(r["query_id"], r["motif"]): r["dist"] for r in rows(spark, "motif_retrieval", d)}
    assert all(x == pytest.approx(np.linalg.norm(z[q] - centres[m]), abs=1e-5) for (q, m), x in hits.items())


def test_agreement_counts_every_neighbour(spark, vectors):
    d, z = vectors
    order = lambda x, q: {i for i in [i for i in np.argsort(((x - x[q]) ** 2).sum(1)) if i != q][:6]}
    for r in rows(spark, "neighbor_jaccard", d):
        a, b = order(z, r["query_id"]), order(z[:, :32], r["query_id"])
        assert r["jaccard"] == pytest.approx(len(a & b) / len(a | b), abs=1e-5)
