"""The bootstrap of statistics that merge against numpy over the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitspark.operators import bootstrap as B
from gaitspark.session import ranked


def weighted_quantile(x, w, q):
    order = np.argsort(x)
    total = np.cumsum(w[order])
    return x[order][np.searchsorted(total, np.ceil(max(q * total[-1], 1)))]


@pytest.mark.parametrize("clusters, rows", [(4, 50), (10_000, 1_000_000)])
def test_statistics_over_the_same_draws(spark, monkeypatch, clusters, rows):
    """Blocks of four clusters, tasks of fifty rows, one cluster with a third of all rows; then as they are."""
    monkeypatch.setattr(B, "CLUSTERS", clusters)
    monkeypatch.setattr(B, "ROWS", rows)
    r = np.random.default_rng(3)
    ids = np.concatenate([np.zeros(300, int), r.integers(1, 23, 600)])
    x = r.normal(5, 3, 900) + ids
    y = x * 0.5 + r.normal(0, 2, 900)
    data = [(f"c{i:02d}", float(a), float(b)) for i, a, b in zip(ids, x, y, strict=True)] + [("c05", None, 1.0), ("c05", float("nan"), 1.0), (None, 1e9, 1e9)]
    df = spark.createDataFrame(data, "session string, x double, y double").repartition(6)
    stats = {"mean": B.Mean("x"), "median": B.Quantile("x", 0.5), "low": B.Quantile("x", 0.05), "r": B.Correlation("x", "y", (10.0, 5.0))}
    got = {g["statistic"]: g for g in B.bootstrap(df, stats, "session", 60, seed=9).collect()}
    names = sorted({d[0] for d in data if d[0]})
    sizes = np.array([len(names[i : i + clusters]) for i in range(0, len(names), clusters)])
    weights = np.concatenate([B.block_weights(sizes, b, 60, 9) for b in range(len(sizes))])
    assert (weights.sum(0) == len(names)).all() and weights[:, 1:].max() > 2
    w = weights[[names.index(f"c{i:02d}") for i in ids]]
    want = {
        "mean": [np.average(x, weights=v) for v in w.T], "median": [weighted_quantile(x, v, 0.5) for v in w.T], "low": [weighted_quantile(x, v, 0.05) for v in w.T],
        "r": [np.cov(x, y, aweights=v)[0, 1] / np.sqrt(np.cov(x, y, aweights=v)[0, 0] * np.cov(x, y, aweights=v)[1, 1]) for v in w.T],
    }
    for name, values in want.items():
        near = 0.011 * np.abs(values).max() if name in ("median", "low") else 1e-9
        assert abs(got[name]["estimate"] - values[0]) <= near, name
        assert abs(got[name]["lo"] - np.quantile(values[1:], 0.025)) <= near and abs(got[name]["hi"] - np.quantile(values[1:], 0.975)) <= near, name
        assert got[name]["clusters"] == len(names)


def test_signs_and_zero_in_quantiles():
    x = np.array([-100.0, -1.0, -0.01, 0.0, 0.0, 0.02, 3.0, 500.0])
    for q in (0.1, 0.3, 0.5, 0.6, 0.8, 1.0):
        s = B.Quantile("x", q)
        got = s.finish(s.update(s.init(1), [x], np.ones((8, 1))))[0]
        want = np.sort(x)[int(np.ceil(max(q * 8, 1))) - 1]
        assert abs(got - want) <= 0.0101 * abs(want), q


def test_nothing_to_draw(spark):
    got = B.bootstrap(spark.createDataFrame([], "session string, x double"), {"mean": B.Mean("x")}, "session", 5).collect()
    assert [tuple(g)[1:5] for g in got] == [(None, None, None, 0)]
    one = B.bootstrap(spark.createDataFrame([("a", None)], "session string, x double"), {"mean": B.Mean("x"), "m": B.Quantile("x", 0.5)}, "session", 5).collect()
    assert [tuple(g)[1:5] for g in one] == [(None, None, None, 1)] * 2


def test_ranks_over_ranges(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("a"), F.col("id").alias("b")).repartition(7)
    got = ranked(df, "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.no)] == sorted((r.a, r.b) for r in got) and sorted(r.no for r in got) == list(range(500))
