"""Trackers and detections on scenes with known identities; streams against batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitspark.operators import tracking as T
from gaitspark.sources import default_scenes
from gaitspark.streaming import latest_annotation_stream, scene_window_stream

DETS = "video_id string, frame long, x1 double, y1 double, x2 double, y2 double, confidence double"


def boxes(points, conf=0.9, video="v", half=8):
    return [(video, f, float(x - half), float(y - half), float(x + half), float(y + half), conf) for f, x, y in points]


def tracks(spark, rows, **kw):
    pts = T.track(spark.createDataFrame(rows, DETS), **kw).toPandas()
    return [g.sort_values("frame") for _, g in pts.groupby("track")]


def run(tracker, frames):
    for f, dets in frames:
        tracker.step(f, np.array(dets, float).reshape(-1, 5))
    return tracker.finish()


@pytest.mark.parametrize("method", ["greedy", "two-stage"])
def test_parallel_animals_keep_their_tracks(spark, method):
    got = tracks(spark, boxes([(f, 10 + 5 * f, 100) for f in range(40)]) + boxes([(f, 10 + 5 * f, 300) for f in range(40)]), method=method)
    assert len(got) == 2 and all(len(g) == 40 and g.y.nunique() == 1 for g in got)


def test_crossing_never_merges_identities(spark):
    way, hidden = default_scenes(spark)
    truth = T.truth_points(way, hidden, 10.0, 8.0)
    dets = truth.select(F.col("scene").alias("video_id"), "frame", (F.col("x") - 8).alias("x1"), (F.col("y") - 8).alias("y1"), (F.col("x") + 8).alias("x2"), (F.col("y") + 8).alias("y2"), F.lit(0.9).alias("confidence"))
    got = T.match_truth(T.track(dets).where("state = 'observed'").withColumnRenamed("video_id", "scene"), truth)
    assert got.agg(F.min("purity")).first()[0] == 1.0
    assert truth.where("scene = 'occlusion' and animal = 'b' and frame between 40 and 50").count() == 0


def test_coincident_detections_split_a_track():
    frames = [(f, [(5 * f, 0, 10, 10, 0.9)]) for f in range(10)] + [(10, [(50, 0, 10, 10, 0.9), (52, 3, 10, 10, 0.9)])]
    done = run(T.TwoStageTracker(), frames)
    assert done[0].ended == "competition" and len(done) == 3 and done[1].parent == 0


def test_short_gap_is_filled_and_long_gap_ends(spark):
    near = [(f, 5.0 * f, 50.0) for f in range(30) if f not in (10, 11)]
    (g,) = tracks(spark, boxes(near))
    assert (g.state == "interpolated").sum() == 2 and list(g.frame) == list(range(30))
    open_gap = [(f, 5.0 * f, 50.0) for f in range(40) if not 10 <= f < 16]
    (g,) = tracks(spark, boxes(open_gap))
    assert (g.state == "interpolated").sum() == 0 and len(g) == 34
    far = [(f, 5.0 * f, 50.0) for f in range(60) if not 10 <= f < 40]
    assert len(tracks(spark, boxes(far))) == 2


def test_faint_detections_keep_a_track(spark):
    rows = boxes([(f, 5.0 * f, 50.0) for f in range(10)]) + boxes([(f, 5.0 * f, 50.0) for f in range(10, 14)], 0.3) + boxes([(f, 5.0 * f, 50.0) for f in range(14, 20)])
    (g,) = tracks(spark, rows)
    assert len(g) == 20
    assert tracks(spark, boxes([(f, 5.0 * f, 50.0) for f in range(10)], 0.3)) == []


def test_chaos_is_left_out():
    t = T.GreedyTracker(chaos=3)
    done = run(t, [(0, [(0, 0, 1, 1, 1)]), (1, [(i, 0, 1, 1, 1) for i in range(4)])])
    assert len(done) == 1 and len(done[0].points) == 1


def test_nms_and_tiles(spark):
    rows = [("v", 0, 0.0, 0.0, 10.0, 10.0, 0.9, "ant"), ("v", 0, 1.0, 1.0, 11.0, 11.0, 0.8, "ant"), ("v", 0, 50.0, 50.0, 60.0, 60.0, 0.2, "ant"), ("v", 1, 1.0, 1.0, 11.0, 11.0, 0.8, "ant")]
    df = spark.createDataFrame(rows, DETS + ", cls string")
    assert T.nms(df, 0.45).count() == 3
    tiles = df.withColumns({"tile_x": F.lit(0.0), "tile_y": F.lit(0.0)}).union(df.withColumns({"x1": F.col("x1") - 5, "x2": F.col("x2") - 5}).withColumns({"tile_x": F.lit(5.0), "tile_y": F.lit(0.0)}))
    assert T.merge_tiles(tiles).count() == 3
    frames = spark.createDataFrame([("v", 2500, 1000), ("w", 500, 500)], "video_id string, width int, height int")
    got = T.tile_windows(frames).collect()
    cover = {(r.x, r.w) for r in got if r.video_id == "v"}
    assert max(x + w for x, w in cover) == 2500 and len([r for r in got if r.video_id == "w"]) == 1


def test_episodes_gate_and_stats(spark):
    pts = T.track(spark.createDataFrame(boxes([(f, 5.0 * f, 50.0) for f in range(100)]) + boxes([(f, 5.0 * f, 400.0) for f in range(10)]), DETS))
    e = T.episodes_of(pts, 30.0, 3.0)
    assert e.count() == 1 and e.first().flags == []
    frames = spark.range(100).select(F.lit("v").alias("video_id"), F.col("id").alias("frame"))
    dets = spark.createDataFrame(boxes([(1, 0, 0)]), DETS)
    assert T.quality_gate(frames, dets, e, 30.0).first().reason == "no detections"
    assert T.run_stats(pts).first().median_length == 100


def test_camera(spark):
    s = spark.createDataFrame([("v", 0, 1.0, 0.0), ("v", 1, 0.1, 0.0), ("v", 2, 500.0, 0.0), ("v", 3, 2.0, 1.0)], "video_id string, frame long, dx double, dy double")
    assert [r.cx for r in T.camera_shift(s).orderBy("frame").collect()] == [1.0, 1.0, 1.0, 3.0]
    p = spark.createDataFrame([("v", 3, 10.0, 10.0)], "video_id string, frame long, x double, y double")
    assert T.stabilized(p, s).first().x == 7.0


def stream(spark, df, tmp_path, parts=3):
    path = str(tmp_path / "in")
    for i in range(parts):
        df.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("_part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def collect(query_df, spark, name, mode, tmp_path):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_annotation_stream(spark, tmp_path):
    log = spark.createDataFrame([("e1", "ant", "accepted", 1, 0), ("e1", None, "rejected", 5, 2), ("e2", "siler", "accepted", 2, 1)], "episode_id string, human_label string, qc_state string, seq long, _part int")
    got = {r.episode_id: r for r in collect(latest_annotation_stream(stream(spark, log, tmp_path)), spark, "ann_t", "complete", tmp_path).collect()}
    assert got["e1"].qc_state == "rejected" and got["e2"].human_label == "siler"


def test_window_stream(spark, tmp_path):
    rows = spark.range(60).select(F.lit("s").alias("scene"), F.concat(F.lit("e"), F.col("id") % 3).alias("episode_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.least(F.floor(F.col("id") / 20), F.lit(2)).cast("int").alias("_part"))
    got = collect(scene_window_stream(stream(spark, rows, tmp_path)), spark, "win_t", "append", tmp_path)
    assert got.count() > 30 and got.agg(F.max("samples")).first()[0] == 2


def test_long_videos_are_walked(spark):
    """More ended tracks than are held, over several videos in one task."""
    rows = [r for v in "abc" for k in range(300) for r in boxes([(12 * k, 100.0, 100.0), (12 * k + 1, 101.0, 100.0)], video=v)]
    got = T.track(spark.createDataFrame(rows, DETS).repartition(3))
    assert got.count() == len(rows) and got.select("video_id", "track").distinct().count() == 900
