"""T-1, T-2, T-3, T-7 over streams: trackers whose state is one entry for each open track.

Detections wait, frame by frame, until the watermark says that their frame is whole;
then the tracker takes its step. Points go out as they come, and a row tells when
and why a track ends, so no track's points are kept. Timers end tracks that have
missed too many frames even where their video is silent.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.segments import STATE
from ..operators.tracking import POINTS, GreedyTracker, Track, TrackerSettings, TwoStageTracker, detections_array, tracker
from ..session import share_package

_COLUMNS = [c.split()[0] for c in POINTS.split(", ")]
_DTYPES = {"long": "Int64", "double": "float64", "string": "string"}
Tracker = GreedyTracker | TwoStageTracker
#: Waiting boxes are kept in blocks of so many frames, one entry each.
BLOCK = 64
#: Rows of tracks that are handed on at once.
GIVEN = 20_000
BOX = np.dtype([("frame", "<i8"), ("x1", "<f8"), ("y1", "<f8"), ("x2", "<f8"), ("y2", "<f8"), ("confidence", "<f8")])


def _entry(t: Track) -> bytes:
    return STATE.pack(*t.points[-1][:6], *t.velocity.tolist(), t.missed)


def _track(number: int, entry: bytes) -> Track:
    frame, x, y, w, h, conf, vx, vy, missed = STATE.unpack(entry)
    return Track(number, [(frame, x, y, w, h, conf, 1.0, "observed")], np.array([vx, vy]), missed=missed)


def _rows(video: str | None, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS[1:])
    out.insert(0, "video_id", video)
    return out.astype({c.split()[0]: _DTYPES[c.split()[1]] for c in POINTS.split(", ")})


def _moved(video: str | None, t: Tracker, before: int | None, frames: Iterable[tuple[int, np.ndarray]], whole: int | None) -> Generator[pd.DataFrame, None, int | None]:
    """Rows of the tracker's steps through frames, which come in order, and the silence up to frame ``whole``, about GIVEN at once; returns the last frame passed."""
    known, rows = {x.number for x in t.live()}, []

    def hand_on(frame: int) -> None:
        done = t.closed(frame)
        for x in [*t.live(), *done]:
            rows.extend((x.number, x.parent if x.number not in known else None, None, *p) for p in x.points[x.number in known :])
            known.add(x.number)
            x.points = x.points[-1:]
        rows.extend((x.number, None, x.ended, *x.points[-1][:1], *[None] * 6, "ended") for x in done)
        known.difference_update(x.number for x in done)

    for frame, boxes in frames:
        if before is not None:
            t.skipped(before, frame)
        t.step(frame, boxes)
        before = frame
        hand_on(frame)
        if len(rows) >= GIVEN:
            yield _rows(video, rows)
            rows.clear()
    if whole is not None and before is not None and whole - 1 > before:
        t.skipped(before, whole)
        before = whole - 1
        hand_on(before)
    if rows:
        yield _rows(video, rows)
    return before


class TrackProcessor(StatefulProcessor):
    """State of a video: its open tracks by number, the waiting boxes by blocks of frames, the last frame passed and how many tracks were born."""

    def __init__(self, make: Callable[[], Tracker], frame_ms: int):
        self.make, self.frame_ms = make, frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "track long", "entry binary")
        self.waiting = handle.getMapState("waiting", "block long", "boxes binary")
        self.clock = handle.getValueState("clock", "frame long, born long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = timerValues.getCurrentWatermarkInMs() // self.frame_ms
        for pdf in rows:
            boxes = np.empty(len(pdf), BOX)
            for c in BOX.names:
                boxes[c] = pdf[c].to_numpy()
            boxes = boxes[boxes["frame"] >= whole]
            for block in np.unique(boxes["frame"] // BLOCK).tolist():
                held = self.waiting.getValue((block,))
                new = boxes[boxes["frame"] // BLOCK == block].tobytes()
                self.waiting.updateValue((block,), ((bytes(held[0]) if held else b"") + new,))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        whole = watermark // self.frame_ms
        before, born = self.clock.get() if self.clock.exists() else (None, 0)
        t, old = self.make(), {k[0]: bytes(v[0]) for k, v in self.open.iterator()}
        t.resume([_track(n, e) for n, e in sorted(old.items())])
        t.born = born
        left = []

        def passed() -> Iterator[tuple[int, np.ndarray]]:
            # One block at a time is fetched and leaves.
            for block in sorted(k[0] for k in self.waiting.keys()):
                boxes = np.frombuffer(bytes(self.waiting.getValue((block,))[0]), BOX)
                later = boxes[boxes["frame"] >= whole]
                if len(later):
                    left.append(int(later["frame"].min()))
                if not len(later):
                    self.waiting.removeKey((block,))
                elif len(later) < len(boxes):
                    self.waiting.updateValue((block,), (later.tobytes(),))
                yield from _frames([boxes], whole)

        before = yield from _moved(key[0], t, before, passed(), whole)
        now = {x.number: _entry(x) for x in t.live()}
        for n in old.keys() - now.keys():
            self.open.removeKey((n,))
        for n, e in now.items():
            if old.get(n) != e:
                self.open.updateValue((n,), (e,))
        if before is not None:
            self.clock.update((before, t.born))
        # The next frame that waits, else the frame by which all open tracks are lost.
        turn = min(left) + 1 if left else max((x.frame for x in t.live()), default=whole) + _gap(t) + 2
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left or now:
            self.handle.registerTimer(max(turn * self.frame_ms, watermark + 1))

    def close(self) -> None:
        pass


def _frames(blocks: Iterable[np.ndarray], whole: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """The boxes of each frame before ``whole``, in order, as trackers take them."""
    boxes = np.concatenate([np.empty(0, BOX), *blocks])
    boxes = np.sort(boxes if whole is None else boxes[boxes["frame"] < whole], order="frame", kind="stable")
    frames, starts = np.unique(boxes["frame"], return_index=True)
    for f, one in zip(frames.tolist(), np.split(boxes, starts[1:]), strict=False):
        yield f, detections_array(one)


def _gap(t: Tracker) -> int:
    return t.gap if isinstance(t, GreedyTracker) else t.s.gap


def track_stream(dets: DataFrame, frame_ms: int, late: str = "0 seconds", method: str = "two-stage", settings: TrackerSettings | None = None, greedy: dict | None = None) -> DataFrame:
    """Rows of tracks (POINTS) of each video as they come, append mode; needs RocksDB as state store, see run_available().

    dets: video_id, ts, frame, x1, y1, x2, y2, confidence, where frame = floor(ts / frame_ms) and
    ts lies behind the epoch, before which Spark takes nothing.
    A frame is whole once the watermark, which is ``late`` behind the latest time seen, has
    passed it; boxes of a whole frame leave, boxes out of order do not matter. Points have
    ended = null, and parent on a track's first point alone; a row with state "ended"
    tells why and after which frame a track ended. tracks_of() puts them together, and
    flush_tracks() gives what the state still holds when the input ends.
    """
    share_package(dets.sparkSession)
    rows = dets.select(F.col("video_id").cast("string").alias("video_id"), "ts", F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "confidence")])
    processor = TrackProcessor(lambda: tracker(method, settings, greedy), frame_ms)
    return rows.withWatermark("ts", late).groupBy("video_id").transformWithStateInPandas(processor, POINTS, "Append", "EventTime")


def flush_tracks(spark: SparkSession, path: str, method: str = "two-stage", settings: TrackerSettings | None = None, greedy: dict | None = None) -> DataFrame:
    """T-7: rows of what run_available(track_stream(...), path) has left in its state: the waiting frames' steps, then the end of every open track.

    A video's share is what came within the watermark's delay, and its open tracks.
    """
    share_package(spark)
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{path}/checkpoint")
    open_ = read("open").select("key.video_id", F.lit("open").alias("kind"), F.col("user_map_key.track").alias("n"), F.lit(0).cast("long").alias("born"), F.col("user_map_value.entry").alias("raw"))
    waiting = read("waiting").select("key.video_id", F.lit("waiting"), F.col("user_map_key.block"), F.lit(0).cast("long"), F.col("user_map_value.boxes"))
    clock = read("clock").select("key.video_id", F.lit("clock"), F.col("value.frame"), F.col("value.born"), F.lit(None).cast("binary"))

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        of = lambda kind: pdf[pdf.kind == kind]
        t, before = tracker(method, settings, greedy), None
        t.resume([_track(int(n), bytes(e)) for n, e in sorted(zip(of("open").n, of("open").raw, strict=True))])
        for n, born in zip(of("clock").n, of("clock").born, strict=True):
            before, t.born = int(n), int(born)
        parts = list(_moved(key[0], t, before, _frames(np.frombuffer(bytes(b), BOX) for b in of("waiting").raw), None))
        return pd.concat([*parts, _rows(key[0], [(x.number, None, x.ended, x.frame, *[None] * 6, "ended") for x in t.finish()])])

    return open_.union(waiting).union(clock).groupBy("video_id").applyInPandas(finish, POINTS)


def tracks_of(rows: DataFrame) -> DataFrame:
    """Points of whole tracks, POINTS, of the rows that a stream and its flush gave: parent and end on each point; an end that nothing told is null."""
    facts = rows.groupBy("video_id", "track").agg(F.max("parent").alias("_parent"), F.max("ended").alias("_ended"))
    points = rows.where("state <> 'ended'").drop("parent", "ended").withColumnsRenamed({"video_id": "_v", "track": "_t"})
    out = points.join(facts, F.col("_v").eqNullSafe(F.col("video_id")) & (F.col("_t") == F.col("track")))
    return out.withColumnsRenamed({"_parent": "parent", "_ended": "ended"}).select(*_COLUMNS)
