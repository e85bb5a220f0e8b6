"""Streams against batches: order, late rows, restarts, what is left at the end."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaitspark.operators import tracking as T
from gaitspark.plans import scenes, streams
from gaitspark.session import shared_path
from gaitspark.streaming import tracks
from gaitspark.streaming import flush_tracks, run_available, session_stream, track_stream, tracks_of

from .oracle import DATA
from .test_segments import DETS, crowd

SCHEMA = DETS + ", ts timestamp"


def key(rows):
    n = lambda x: None if x is None else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(map(n, r)) for r in rows), key=str)


class Source:
    """A folder that files are added to, read one file a micro-batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def add(self, df):
        df.coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def timed(spark, rows):
    return spark.createDataFrame([(v, f + 1, *box) for v, f, *box in rows], DETS).withColumn("ts", F.timestamp_seconds("frame"))


@pytest.mark.parametrize("method, greedy", [("two-stage", None), ("greedy", {"gap": 3, "jump": 30.0})])
def test_tracks_of_a_stream_are_the_batch(spark, tmp_path, method, greedy):
    """Files that overlap in time, two runs with a restart between: the points, numbers and parents of one walk."""
    df = timed(spark, crowd(3, ["a", "b"], 120)).cache()
    source, path = Source(spark, tmp_path / "in", SCHEMA), str(tmp_path / "out")
    # Each file has 30 seconds, but a tenth of the boxes come in the file after it.
    part = F.floor((F.col("frame") + F.when(F.pmod(F.xxhash64("x1"), F.lit(10)) == 0, 10).otherwise(0)) / 30)
    stream = lambda: track_stream(source.stream(), 1000, "12 seconds", method, greedy=greedy)
    for i in (0, 1):
        source.add(df.where(part == i))
    first = run_available(stream(), path).count()
    for i in (2, 3, 4):
        source.add(df.where(part == i))
    rows = run_available(stream(), path)
    assert 0 < first < rows.count()
    got = tracks_of(rows.union(flush_tracks(spark, path, method, greedy=greedy))).collect()
    want = T.track(df, method, greedy=greedy).collect()
    plain = lambda rows: key((r.video_id, r.track, r.parent, r.frame, r.x, r.y, r.confidence, r.state) for r in rows)
    assert len(want) > 400 and plain(got) == plain(want)
    ends = lambda rows: {(r.video_id, r.track): r.ended for r in rows}
    told = ends(got)
    assert all(told[k] in (v, "lost") for k, v in ends(want).items() if v == "end") and all(told[k] == v for k, v in ends(want).items() if v not in ("end", "open"))


def test_silent_videos_end_by_timers_and_late_boxes_leave(spark, tmp_path):
    box = lambda v, f, x: (v, f, x, 0.0, x + 10, 10.0, 0.9)
    source, path = Source(spark, tmp_path / "in", SCHEMA), str(tmp_path / "out")
    source.add(timed(spark, [box("silent", f, 5.0 * f) for f in range(5)] + [box("busy", f, 5.0 * f) for f in range(40)]))
    source.add(timed(spark, [box("busy", 40, 200.0), box("silent", 2, 400.0)]))
    rows = run_available(track_stream(source.stream(), 1000, "2 seconds"), path)
    ended = rows.where("state = 'ended'").collect()
    assert [(r.video_id, r.track, r.ended, r.frame) for r in ended] == [("silent", 0, "lost", 5)]
    assert rows.where("video_id = 'silent' and state = 'observed'").count() == 5
    left = flush_tracks(spark, path)
    assert [(r.video_id, r.ended, r.frame) for r in left.where("state = 'ended'").collect()] == [("busy", "end", 41)]


def test_visits_close_behind_the_watermark(spark, tmp_path):
    rows = [(e, t) for e, ts in {"a": (0, 5, 9, 60, 61), "b": (50, 100)}.items() for t in ts]
    df = spark.createDataFrame(rows, "episode_id string, t long").select("episode_id", F.timestamp_seconds("t").alias("ts"))
    source = Source(spark, tmp_path / "in", df.schema)
    source.add(df)
    got = run_available(session_stream(source.stream(), "10 seconds", "0 seconds"), str(tmp_path / "out"))
    assert key(got.select("episode_id", F.unix_timestamp("start"), F.unix_timestamp("last"), "samples").collect()) == [("a", 0, 9, 3), ("a", 60, 61, 2), ("b", 50, 50, 1)]


def test_stream_of_events_is_the_batch(spark):
    got = streams.QUERIES["streamed_tracks"](spark, DATA)
    want = T.track(scenes.hourly_detections(spark, DATA)).groupBy("video_id", "track").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"), F.max("parent").alias("parent"))
    assert key(got.collect()) == key(want.select(*got.columns).collect())


def test_shared_paths_are_fresh(spark):
    assert shared_path(spark, "x") != shared_path(spark, "x")


def test_rows_are_handed_on_in_parts(monkeypatch):
    """What a long walk gives leaves in parts of bounded size, and is that of a walk that gives it at once."""
    boxes = [(f, np.array([[10.0 * i + f, 5.0, 6.0, 6.0, 0.9] for i in range(20)])) for f in range(300)]
    got = {}
    for most in (100, 10**9):
        monkeypatch.setattr(tracks, "GIVEN", most)
        got[most] = list(tracks._moved("v", T.tracker("greedy", None, {"gap": 3, "jump": 30.0}), None, iter(boxes), None))
    assert len(got[10**9]) == 1 and len(got[100]) == 60 and max(map(len, got[100])) <= 120
    assert pd.concat(got[100], ignore_index=True).equals(got[10**9][0])
