"""Features against numpy, and what must not change them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitspark.operators import kinematics as K
from gaitspark.schema import FEATURES
from gaitspark.sources import synthetic_tracks


@pytest.fixture(scope="module")
def tracks(spark):
    return synthetic_tracks(spark, 6, 200, seed=3).persist()


def features(df, **kw):
    return {r.episode_id: r for r in K.trajectory_features(df, **kw).collect()}


def by_numpy(x, y, fps):
    dx, dy = np.diff(x), np.diff(y)
    length, heading = np.hypot(dx, dy), np.arctan2(dy, dx)
    v = length * fps
    turn = np.abs((np.diff(heading) + np.pi) % (2 * np.pi) - np.pi)
    moving = v > max(0.1 * np.median(v), 1e-9)
    cut = np.flatnonzero(np.diff(moving.astype(int))) + 1
    runs = [(r[0], len(r)) for r in np.split(moving, cut)]
    net = math.hypot(x[-1] - x[0], y[-1] - y[0])
    mean = lambda a: float(np.mean(a)) if len(a) else 0.0
    return {
        "duration_s": len(x) / fps, "distance": length.sum(), "net_displacement": net, "sinuosity": length.sum() / max(net, 1e-9), "speed_mean": v.mean(), "speed_cv": v.std() / v.mean(), "speed_p90": np.percentile(v, 90),
        "accel_rms": math.sqrt(np.mean(np.diff(v) ** 2)) * fps, "turn_rate_mean": mean(turn * fps), "turn_rate_p90": np.percentile(turn * fps, 90), "curvature_mean": mean(turn / np.maximum(length[1:], 1e-9)), "frac_time_moving": moving.mean(),
        "n_pauses": sum(not m for m, _ in runs), "pause_run_mean_s": mean([n for m, n in runs if not m]) / fps, "move_run_mean_s": mean([n for m, n in runs if m]) / fps, "straightness_index": net / max(length.sum(), 1e-9),
    }


def test_against_numpy(tracks):
    got = features(tracks)
    for name, pdf in tracks.toPandas().sort_values("frame").groupby("episode_id"):
        want = by_numpy(pdf.x.to_numpy(), pdf.y.to_numpy(), 30.0)
        for f in FEATURES:
            assert got[name][f] == pytest.approx(want[f], rel=1e-9, abs=1e-9), (name, f)


def test_rotation_and_translation_change_nothing(spark):
    r = np.random.default_rng(4)  # without rests, whose headings are only rounding
    heading, step = np.cumsum(r.normal(0, 0.4, 150)), r.uniform(0.5, 3.0, 150)
    x, y = np.cumsum(step * np.cos(heading)), np.cumsum(step * np.sin(heading))
    tracks = spark.createDataFrame([("e", i, float(x[i]), float(y[i]), 30.0, None) for i in range(150)], "episode_id string, frame long, x double, y double, fps double, px_per_cm double")
    a, b = features(tracks), features(K.translate(K.rotate(tracks, 1.1), 37.0, -4.0))
    for n in a:
        for f in FEATURES:
            assert b[n][f] == pytest.approx(a[n][f], rel=1e-6, abs=1e-6), f


def test_compat_has_no_pauses(tracks):
    assert all(r.n_pauses == 0 and r.pause_run_mean_s == 0 for r in features(tracks, compat=True).values())
    assert any(r.n_pauses > 0 for r in features(tracks).values())


def test_short_and_missing(spark):
    rows = [("one", 0, 1.0, 1.0), ("nan", 0, float("nan"), 1.0), ("nan", 1, None, 1.0)]
    df = spark.createDataFrame(rows, "episode_id string, frame long, x double, y double").withColumns({"fps": F.lit(30.0), "px_per_cm": F.lit(None).cast("double")})
    got = features(df)
    assert set(got) == {"one", "nan"} and all(got[n][f] == 0 for n in got for f in FEATURES)


def test_calibration_scales_lengths(tracks):
    a, b = features(tracks), features(tracks.withColumn("px_per_cm", F.lit(10.0)))
    n = next(iter(a))
    assert b[n].distance == pytest.approx(a[n].distance / 10) and b[n].turn_rate_mean == pytest.approx(a[n].turn_rate_mean)


@pytest.mark.parametrize("n,m", [(1, 5), (4, 5), (5, 5), (17, 5), (200, 64), (1000, 160)])
def test_resample_like_linspace(spark, n, m):
    df = spark.range(n).select(F.lit("e").alias("episode_id"), F.col("id").alias("i"))
    got = sorted(r.i for r in K.resample(df, "i", m).collect())
    assert got == (list(range(n)) if n <= m else sorted({i * (n - 1) // (m - 1) for i in range(m)}))


def test_shape_series_are_even(spark, tracks):
    short = tracks.where("frame < 20")
    assert {len(r.z) for r in K.shape_series(tracks.unionByName(short.withColumn("episode_id", F.concat("episode_id", F.lit("s"))))).collect()} == {128}
