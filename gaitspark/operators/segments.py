"""T-1, T-2, T-11: one video tracked by many tasks, with the tracks of a single walk.

A video is cut into segments of frames, and each is walked by a task of its own. A
walk begins some frames before its segment, with no tracks; by the time it enters
the segment it nearly always has the open tracks that the walk of the segment before
leaves it with, for what a tracker does next follows from each track's last point,
velocity and misses alone. Where both states are the same, so is everything behind
them. Where they differ, the segment is walked again from the state before it, all
such segments side by side, until no state differs: then all are what one walk over
the whole video would give. At last the tracks that cross from segment to segment
take the number under which they were born, by pointer doubling over the crossings.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled, share_package
from .tracking import POINTS, Track, TrackerSettings, _runs, detections_array, tracker

#: A track's last point, velocity and misses: all that decides what comes next.
STATE = struct.Struct("<q7dq")
WALKED = (
    "kind string, video_id string, segment long, id long, parent long, ended string, tail boolean, frame long, x double, y double, w double, h double, "
    "confidence double, association double, state string, entry binary, exit binary, exits array<long>, births long, own long"
)
_NAMES = [c.split()[0] for c in WALKED.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_KINDS = [_TYPES[c.split()[1]] for c in WALKED.split(", ")]


def _packed(tracks: list[Track]) -> bytes:
    return b"".join(STATE.pack(*t.points[-1][:6], *t.velocity.tolist(), t.missed) for t in tracks)


def _unpacked(states: bytes) -> list[Track]:
    """Tracks that go on from packed states, numbered -1, -2, ..."""
    out = []
    for j, (frame, x, y, w, h, conf, vx, vy, missed) in enumerate(STATE.iter_unpack(states)):
        out.append(Track(-1 - j, [(frame, x, y, w, h, conf, 1.0, "observed")], np.array([vx, vy]), missed=missed))
    return out


class _Walk:
    """The walk of one segment; rows are dictionaries of what WALKED names."""

    def __init__(self, video, segment: int, length: int, make):
        self.video, self.segment, self.first, self.end = video, segment, segment * length, (segment + 1) * length
        self.t, self.before, self.entry, self.own, self.rows, self.seen = make(), None, None, 0, [], set()

    def _enter(self, states: bytes | None = None) -> None:
        if states is not None:
            self.t.resume(_unpacked(states))
        else:
            if self.before is not None:
                self.t.skipped(self.before, self.first)
            self.t.closed(self.first - 1)
            tracks = self.t.live()
            self.t.resume(tracks)
            for j, t in enumerate(tracks):
                t.number, t.parent, t.points = -1 - j, None, t.points[-1:]
        self.t.born, self.before = 0, self.first - 1
        self.entry = _packed(self.t.live())
        self.seen = {t.number for t in self.t.live()}

    def _hand_on(self, frame: int, tail: bool = False) -> None:
        """What the last step has added to tracks, and which it has ended; tracks keep their last point only."""
        done = self.t.closed(frame)
        for t in [*self.t.live(), *done]:
            new = t.points[t.number in self.seen :]
            if self.entry is not None:
                if t.number not in self.seen and t.parent is not None:
                    self.rows.append({"kind": "birth", "id": t.number, "parent": t.parent})
                self.rows += [{"kind": "point", "id": t.number} | dict(zip(("frame", "x", "y", "w", "h", "confidence", "association", "state"), p, strict=True)) for p in new]
            self.seen.add(t.number)
            t.points = t.points[-1:]
        for t in done:
            self.seen.discard(t.number)
            if self.entry is not None and t.ended != "open":
                self.rows.append({"kind": "fate", "id": t.number, "ended": t.ended, "tail": tail})

    def step(self, frame: int | None, dets: np.ndarray, states: bytes | None) -> None:
        if frame is None:
            self._enter(states)
            return
        if frame >= self.first and self.entry is None:
            self._enter()
        if self.before is not None:
            self.t.skipped(self.before, frame)
        self.t.step(frame, dets)
        self.before, self.own = frame, self.own + (frame >= self.first)
        self._hand_on(frame)

    def finish(self) -> None:
        if self.entry is None:
            self._enter()
        self.t.skipped(self.before, self.end)
        self._hand_on(self.end - 1, tail=True)
        live = self.t.live()
        self.rows.append({"kind": "state", "entry": self.entry, "exit": _packed(live), "exits": [t.number for t in live], "births": self.t.born, "own": self.own})

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        fixed = {"video_id": self.video, "segment": self.segment}
        return pa.RecordBatch.from_arrays([pa.array([fixed[n]] * len(rows) if n in fixed else [r.get(n) for r in rows], k) for n, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def _walked(rows: DataFrame, length: int, make, round_: int) -> DataFrame:
    """Walks of rows (video_id, segment, frame, box, confidence, states), written; a row without frame holds the states to begin with."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        walk = None
        for (video, segment, frame), dets in _runs(batches, ["video_id", "segment", "frame"]):
            if walk is None or (video, segment) != (walk.video, walk.segment):
                if walk:
                    walk.finish()
                    yield walk.taken()
                walk = _Walk(video, segment, length, make)
            states = dets.column("states")[0].as_py() if frame is None else None
            walk.step(frame, None if frame is None else detections_array(dets), states)
            if len(walk.rows) > 5_000:
                yield walk.taken()
        if walk:
            walk.finish()
            yield walk.taken()

    dealt = rows.repartition("video_id", "segment").sortWithinPartitions("video_id", "segment", "frame")
    return settled(dealt.mapInArrow(run, WALKED).withColumn("round", F.lit(round_)), "walked")


def _latest(parts: list[DataFrame], kind: str) -> DataFrame:
    """Rows of a kind from each segment's last walk."""
    rows = [p.where(F.col("kind") == kind) for p in parts]
    out = rows[0]
    for later, part in zip(parts[1:], rows[1:], strict=True):
        out = out.join(later.where("kind = 'state'").select("video_id", "segment"), ["video_id", "segment"], "left_anti").unionByName(part)
    return out


def _differing(parts: list[DataFrame]) -> DataFrame:
    """(video_id, segment, states) of segments that were entered with other states than the segment before was left with."""
    s = _latest(parts, "state").select("video_id", "segment", "entry", "exit")
    before = s.select("video_id", (F.col("segment") + 1).alias("segment"), F.col("exit").alias("states"))
    none = F.lit(b"")
    return s.join(before, ["video_id", "segment"], "left").select("video_id", "segment", "entry", F.coalesce("states", none).alias("states")).where("entry <> states").drop("entry")


def _crossings(states: DataFrame) -> DataFrame:
    """(video_id, segment, id, from_segment, from_id): the segment in which a track that enters one was born, and its number there."""
    exits = states.select("video_id", "segment", F.posexplode("exits").alias("j", "from_id"))
    links = exits.select("video_id", (F.col("segment") + 1).alias("segment"), (-F.col("j") - 1).cast("long").alias("id"), F.col("segment").alias("from_segment"), "from_id")
    now = settled(links, "links")
    while now.where("from_id < 0").take(1):
        up = now.select("video_id", F.col("segment").alias("from_segment"), F.col("id").alias("from_id"), F.col("from_segment").alias("s"), F.col("from_id").alias("i"))
        far = now.where("from_id < 0").join(up, ["video_id", "from_segment", "from_id"]).select("video_id", "segment", "id", F.col("s").alias("from_segment"), F.col("i").alias("from_id"))
        now = settled(now.where("from_id >= 0").unionByName(far), "links")
    return now


def track_segments(dets: DataFrame, length: int = 2048, warm: int = 64, method: str = "two-stage", settings: TrackerSettings | None = None, greedy: dict | None = None) -> DataFrame:
    """The points of tracking.track(), POINTS, each video walked by as many tasks as it has segments of ``length`` frames.

    dets: video_id, frame (from 0), x1, y1, x2, y2, confidence. A walk begins ``warm``
    frames early; fewer make more second walks, but the same result. Both must be more
    than the tracker's gap. Null videos are one video; rows without a frame leave. A segment
    is held by one task a frame at a time, with the open tracks.
    """
    make = lambda: tracker(method, settings, greedy)
    gap = make().gap if method == "greedy" else make().s.gap
    if not gap + 1 < warm <= length:
        raise ValueError(f"a segment of {length} frames with {warm} before it is too short for a gap of {gap}")
    share_package(dets.sparkSession)
    box = ["x1", "y1", "x2", "y2", "confidence"]
    rows = dets.where("frame is not null").select(F.coalesce(F.col("video_id").cast("string"), F.lit("\0")).alias("video_id"), F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("double").alias(c) for c in box])
    own = F.floor(F.col("frame") / length)
    ahead = F.floor((F.col("frame") + warm) / length)
    dealt = rows.withColumn("segment", F.explode(F.array_distinct(F.array(own, ahead)))).withColumn("states", F.lit(None).cast("binary"))
    parts = [_walked(dealt, length, make, 0)]
    while True:
        again = settled(_differing(parts), "again")
        if not again.take(1):
            break
        starts = again.select("video_id", "segment", F.lit(None).cast("long").alias("frame"), *[F.lit(None).cast("double").alias(c) for c in box], "states")
        inside = dealt.where(own == F.col("segment")).join(again.select("video_id", "segment"), ["video_id", "segment"], "left_semi")
        parts.append(_walked(inside.select(*starts.columns).unionByName(starts), length, make, len(parts)))

    states = settled(_latest(parts, "state").select("video_id", "segment", "exits", "births", "own"), "states")
    earlier = W.partitionBy("video_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(F.col("own") > 0, F.col("segment"))).over(W.partitionBy("video_id"))
    counts = states.select("video_id", "segment", F.coalesce(F.sum("births").over(earlier), F.lit(0)).alias("start"), (F.col("segment") < last).alias("goes_on"))
    crossed = _crossings(states)
    numbers = crossed.join(counts.select("video_id", F.col("segment").alias("from_segment"), "start"), ["video_id", "from_segment"])
    numbers = settled(numbers.select("video_id", "segment", "id", (F.col("start") + F.col("from_id")).alias("number")), "numbers")

    def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
        """rows (with start) with a segment's own number as the video's."""
        known = numbers.withColumnsRenamed({"id": column, "number": "_n"})
        return rows.join(known, ["video_id", "segment", column], "left").withColumn(name, F.coalesce("_n", F.col("start") + F.col(column))).drop("_n")

    def of(kind: str) -> DataFrame:
        return numbered(_latest(parts, kind).join(counts, ["video_id", "segment"]), "id", "track")

    births = numbered(of("birth").withColumnRenamed("parent", "old"), "old", "parent").select("video_id", "track", "parent", F.lit(None).cast("string").alias("ended"))
    # A track that misses frames up to the end of its video is not lost: nothing tells.
    fates = of("fate").where("not tail or goes_on").select("video_id", "track", F.lit(None).cast("long").alias("parent"), "ended")
    facts = births.unionByName(fates).groupBy("video_id", "track").agg(F.max("parent").alias("parent"), F.max("ended").alias("ended"))
    points = of("point").drop("parent", "ended").join(facts, ["video_id", "track"], "left")
    open_end: Column = F.lit("open" if method == "greedy" else "end")
    points = points.withColumns({"ended": F.coalesce("ended", open_end), "video_id": F.when(F.col("video_id") != "\0", F.col("video_id"))})
    return points.select(*(F.col(c.split()[0]) for c in POINTS.split(", ")))
