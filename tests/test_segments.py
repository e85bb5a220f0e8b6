"""Tracking by segments against one walk over each video."""

import random

import pytest
from pyspark.sql import functions as F

from gaitspark.operators import segments as S
from gaitspark.operators import tracking as T
from gaitspark.plans import scenes

from .oracle import DATA

DETS = "video_id string, frame long, x1 double, y1 double, x2 double, y2 double, confidence double"


def crowd(seed, videos, frames, animals=6, miss=0.15, width=300):
    """Animals that wander, vanish now and then, and meet."""
    r, rows = random.Random(seed), []
    for v in videos:
        for _ in range(animals):
            x, y, f = r.uniform(0, width), r.uniform(0, width), r.randint(0, frames // 3)
            while f < frames:
                x, y = (x + r.gauss(3, 6)) % width, (y + r.gauss(0, 6)) % width
                if r.random() > miss:
                    rows.append((v, f, x - 5, y - 5, x + 5, y + 5, r.choice([0.9, 0.9, 0.7, 0.3, 0.1])))
                f += 1 if r.random() > 0.01 else r.randint(2, 40)
    return rows


def key(df):
    n = lambda x: None if x is None else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(map(n, r)) for r in df.collect()), key=str)


@pytest.mark.parametrize("method, greedy", [("two-stage", None), ("greedy", {"gap": 3, "jump": 30.0})])
@pytest.mark.parametrize("length, warm", [(64, 12), (17, 10)])
def test_segments_are_one_walk(spark, method, greedy, length, warm):
    rows = crowd(length, ["a", "b", None], 300) + crowd(1, ["sparse"], 3000, animals=1, miss=0.9)
    df = spark.createDataFrame(rows, DETS).repartition(5)
    want = T.track(df, method, greedy=greedy)
    got = S.track_segments(df, length, warm, method, greedy=greedy)
    rows = key(got)
    assert got.columns == want.columns and rows == key(want)
    assert len(rows) > 500 and len({r[:2] for r in rows}) > 50


def test_states_that_differ_are_walked_again(spark, monkeypatch):
    """Faint detections keep a track but start none, so later walks enter without it and have to be walked again, one after the other."""
    walks = []
    real = S._walked
    monkeypatch.setattr(S, "_walked", lambda *a: (walks.append(a[3]), real(*a))[1])
    faint = [("a", f, 2.0 * f, 500.0, 2.0 * f + 10, 510.0, 0.9 if f < 10 else 0.3) for f in range(90)]
    df = spark.createDataFrame(crowd(5, ["a", "b"], 90) + faint, DETS)
    assert key(S.track_segments(df, 20, 10)) == key(T.track(df))
    assert len(walks) == 5


def test_splits_and_ends_across_segments(spark):
    """A split's parent may be born, and a track may end, in other segments than the points."""
    rows = [("v", f, 5.0 * f, 0.0, 5.0 * f + 10, 10.0, 0.9) for f in range(100)] + [("v", 100, 502.0, 3.0, 512.0, 13.0, 0.9), ("v", 100, 500.0, 0.0, 510.0, 10.0, 0.9)] + [("v", 400, 0.0, 0.0, 10.0, 10.0, 0.9)]
    df = spark.createDataFrame(rows, DETS)
    got = S.track_segments(df, 30, 12)
    assert key(got) == key(T.track(df))
    t = {r["track"]: r for r in got.groupBy("track").agg(F.max("ended").alias("ended"), F.max("parent").alias("parent"), F.count("*").alias("n")).collect()}
    assert t[0]["ended"] == "competition" and t[0]["n"] == 100 and t[1]["parent"] == 0 and t[2]["ended"] == "lost" and t[3]["ended"] == "end"


def test_empty_and_odd_rows(spark):
    assert S.track_segments(spark.createDataFrame([], DETS), 20, 10).count() == 0
    rows = [("v", None, 0.0, 0.0, 1.0, 1.0, 0.9), ("v", 3, 0.0, 0.0, 1.0, 1.0, 0.9), ("v", 3, 0.0, 0.0, 1.0, 1.0, 0.9)]
    df = spark.createDataFrame(rows, DETS).withColumns({"segment": F.lit("x"), "states": F.lit("x"), "kind": F.lit(1)})
    assert key(S.track_segments(df, 20, 10)) == key(T.track(df.where("frame is not null")))
    with pytest.raises(ValueError):
        S.track_segments(df, 20, 5)


@pytest.mark.parametrize("method", ["greedy", "two-stage"])
def test_queries_are_one_walk(spark, method):
    dets = scenes.hourly_detections(spark, DATA)
    assert key(scenes.tracked_events(spark, DATA, method)) == key(T.track(dets, method, greedy={"gap": 3}))
