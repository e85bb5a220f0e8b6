"""Pairs of a frame stay in their task: same results as all pairs, and no join that makes rows of them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitspark.operators import assignment as AS
from gaitspark.operators import cells as C
from gaitspark.operators import interaction as I
from gaitspark.operators import tracking as T

SAMPLES = "scene string, episode_id long, frame long, x double, y double, fps double, px_per_cm double, label string"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def crowd(n=40, frames=6, seed=3):
    r = random.Random(seed)
    return [("s", e, f, float(r.randint(0, 60)), float(r.randint(0, 40)), 1.0, None, "ant" if e % 4 == 0 else "siler") for e in range(n) for f in range(frames) if r.random() < 0.8]


@pytest.mark.parametrize("kind", ["even", "ties", "clusters", "line", "point", "outlier"])
def test_nearest_is_that_of_all(kind, monkeypatch):
    monkeypatch.setattr(C, "PAIRS", 500)
    r = np.random.default_rng(1)
    p, t = r.random((150, 2)) * 120 - 10, r.random((400, 2)) * 100
    if kind == "ties":
        p, t = p.round(-1), t.round(-1)
    if kind == "clusters":
        t = np.concatenate([t[:200] / 1000, 90 + t[200:] / 100])
    if kind == "line":
        t[:, 1] = 5
    if kind == "point":
        t[:] = 7
    if kind == "outlier":
        t[0] = 1e9
    d, at = C.nearest(*p.T, *t.T)
    every = np.sqrt((p[:, None, 0] - t[None, :, 0]) ** 2 + (p[:, None, 1] - t[None, :, 1]) ** 2)
    assert (d == every.min(1)).all() and (at == every.argmin(1)).all()


def test_truth_is_matched_without_pairs(spark):
    r = random.Random(5)
    points = [("s", k % 9, f, r.random() * 50, r.random() * 50) for f in range(5) for k in range(12)] + [("s", 1, 2, None, 1.0), ("t", 1, 0, 0.0, 0.0)]
    truth = [("s", f, f"a{k}", r.random() * 50, r.random() * 50) for f in range(5) for k in range(20)] + [("s", 2, "a0", None, None)]
    p, t = spark.createDataFrame(points, "scene string, track long, frame long, x double, y double"), spark.createDataFrame(truth, "scene string, frame long, animal string, x double, y double")
    near = C.nearest_in_frame(p, t.withColumnsRenamed({"x": "tx", "y": "ty"}))
    want = {}
    for s, k, f, x, y in points:
        for s2, f2, a, tx, ty in truth:
            if (s, f) == (s2, f2) and None not in (x, y, tx, ty):
                want[k, f] = min(want.get((k, f), (math.inf, "")), (math.sqrt((x - tx) ** 2 + (y - ty) ** 2), a))
    assert {(r.track, r.frame): (r.d, r.animal) for r in near.collect()} == want
    assert "Join" not in plan(T.match_truth(p, t))


def test_context_is_that_of_all_pairs(spark):
    df = spark.createDataFrame(crowd(), SAMPLES)
    got = I.neighbor_context(df, [5.0, 20.0])
    pairs = I.frame_pairs(df)
    for r in (5.0, 20.0):
        ant, near = F.col("neighbor_label") == "ant", F.col("distance") <= r
        per = pairs.groupBy("focal", "frame").agg(F.min("distance").alias("d"), F.count_if(near).alias("n"), F.count_if(near & ant).alias("a"), F.avg(F.when(near & ant, F.col("neighbor_speed"))).alias("v"))
        want = per.groupBy("focal").agg(F.avg("d").alias("nearest_mean"), F.avg("n").alias("mean_near"), F.avg("a").alias("mean_ants"), F.avg("v").alias("ant_speed"))
        rounded = lambda d: sorted(tuple(None if v is None else round(v, 9) for v in x) for x in d.select("focal", "nearest_mean", "mean_near", "mean_ants", "ant_speed").collect())
        assert rounded(got.where(F.col("radius") == r)) == rounded(want)
    assert "n_episode_id" not in plan(got)


@pytest.mark.parametrize("chain", [False, True])
def test_frames_are_assigned_as_their_pairs(spark, chain, monkeypatch):
    monkeypatch.setattr(C, "PAIRS", 300)
    r = random.Random(2)
    # In a chain each pair waits for the one before it.
    at = [(sum(range(k)) / 40 + k, 0.0) for k in range(60)] if chain else [(float(r.randint(0, 70)), float(r.randint(0, 70))) for _ in range(90)]
    box = lambda x, y: (x - 3, y - 3, x + 3, y + 3)
    tracks = spark.createDataFrame([("v", 1, k, 0, x, y, *box(x, y)) for k, (x, y) in enumerate(at)], "video_id string, frame long, track long, last_frame long, x double, y double, x1 double, y1 double, x2 double, y2 double")
    dets = spark.createDataFrame([("v", 1, k, *box(x + (0.45 if chain else r.randint(-9, 9)), y)) for k, (x, y) in enumerate(at)], "video_id string, frame long, detection long, x1 double, y1 double, x2 double, y2 double")
    got = C.assign_gated(tracks, dets, per=1000.0)
    group = ["video_id", "frame"]
    want = AS.greedy_assignment(AS.gated_costs(tracks, dets).withColumn("cost", F.floor(F.col("cost") * 1000)), [*group, "track"], [*group, "detection"])
    rows = lambda d: sorted((x.track, x.detection, int(x.cost)) for x in d.collect())
    assert rows(got) == rows(want) and got.count() > 50 and "Join" not in plan(got)
