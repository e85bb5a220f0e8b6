import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitspark.operators import models, permutation
from gaitspark.operators.hierarchy import mixed_hash
from gaitspark.plans import catalog

from .oracle import compare

LARGER = "/root/testdata/sf0.01"


def _rows(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    made = []
    for i in range(n):
        key = (None, "one", "two", "two", "two")[i % 5]
        value = None if i % 37 == 0 else float(round(rng.normal(i % 2, 2.0), 1))
        made.append((f"e{i:04d}", key, value, "a" if rng.random() < 0.3 else ("b" if i % 7 else None)))
    made += [("x1", "alone", 1.0, "a"), ("x2", "alone", 3.0, "a"), ("x3", "other", 2.0, "b"), ("x4", "nan", float("nan"), "a"), ("x5", "nan", 1.0, "b"), ("x6", "nan", 2.0, "a")]
    return made, spark.createDataFrame(made, "id string, dim string, value double, side string").repartition(5)


def test_draw_is_the_column(spark):
    j = np.arange(0, 3_000_000_000, 77_777_777)
    for b in (0, 7, 199):
        got = [r[0] for r in spark.createDataFrame([(int(x),) for x in j], "j long").select(mixed_hash(F.lit(b).cast("long"), F.col("j"))).collect()]
        assert got == permutation.draw(b, j).tolist()


@pytest.mark.parametrize("most", [permutation.MOST, 100, 1])
def test_contrast_equals_brute_force(spark, most):
    made, df = _rows(spark)
    got = {r["dim"]: r for r in permutation.permutation_contrast(df, ["dim"], shuffles=20, most=most).collect()}
    assert set(got) == {None, "one", "two", "alone", "other", "nan"}
    for key, row in got.items():
        own = sorted((i, v, s == "a") for i, k, v, s in made if k == key and v is not None)
        value, real = np.array([v for _, v, _ in own]), np.array([a for *_, a in own])
        n_a = int(real.sum())
        assert (row["n_a"], row["n_b"]) == (n_a, len(own) - n_a)
        if not 0 < n_a < len(own):
            assert row["diff"] is None and row["null_lo"] is None and row["p_perm"] == 1 / 21
            continue
        middle = lambda v: float(np.median(np.sort(v)))
        if key == "nan":
            assert np.isnan(row["median_a"]) and row["median_b"] == 1.0
            continue
        diff = middle(value[real]) - middle(value[~real])
        null = []
        for b in range(20):
            first = np.lexsort((np.arange(len(own)), permutation.draw(b, np.arange(len(own)))))[:n_a]
            rest = np.setdiff1d(np.arange(len(own)), first)
            null.append(middle(value[first]) - middle(value[rest]))
        assert row["diff"] == pytest.approx(diff, abs=1e-12)
        assert (row["null_lo"], row["null_hi"]) == pytest.approx(tuple(np.quantile(null, [0.025, 0.975])), abs=1e-9)
        assert row["p_perm"] == pytest.approx((sum(abs(d) >= abs(diff) - 1e-12 for d in null) + 1) / 21)


def test_no_task_holds_a_large_key(spark):
    """One key over many tasks gives what one task gives."""
    df = spark.range(0, 30_000, 1, 7).select(F.col("id"), F.lit("k").alias("dim"), ((F.col("id") * 7919) % 10_007).cast("double").alias("value"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("side"))
    whole = permutation.permutation_contrast(df, ["dim"], shuffles=12).collect()
    assert permutation.permutation_contrast(df, ["dim"], shuffles=12, most=2_000).collect() == whole


def test_empty(spark):
    assert permutation.permutation_contrast(spark.createDataFrame([], "id long, dim string, value double, side string"), ["dim"]).collect() == []


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")
@pytest.mark.parametrize("name", ["permutation_contrast", "episodes_of_tracks"])
def test_matches_sql_on_more_rows(spark, name):
    compare(spark, name, catalog.queries()[name], catalog.oracle_sql()[name], LARGER)


def test_kmeans_in_one_task_or_many(spark):
    rng = np.random.default_rng(5)
    points = [([*map(float, rng.integers(-9, 9, 4) + 30 * (i % 3))],) for i in range(400)]
    df = spark.createDataFrame(points, "z array<double>").repartition(6).cache()
    one, rounds = models.kmeans(df, 5)
    many, again = models.kmeans(df, 5, task_bytes=2_000)
    assert rounds == again and np.allclose(one, many)
