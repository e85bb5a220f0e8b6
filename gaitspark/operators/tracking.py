"""From detections to tracks and episodes: suppression, tiling, trackers, purity.

Trackers are sequential in time, so a video is the unit of a task; videos are
independent and spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import iou

# --- detections ---------------------------------------------------------------


def scan_detections(dets: DataFrame, stride: int = 1, region: tuple[float, float, float, float] | None = None, last_frame: int | None = None) -> DataFrame:
    """Detections of every ``stride``-th frame up to last_frame, with their centre in region (x, y, width, height), moved to its corner.

    Frame numbers stay those of the source.
    """
    rows = dets.where(F.col("frame") % max(stride, 1) == 0)
    if last_frame:
        rows = rows.where(F.col("frame") <= last_frame)
    if region:
        x, y, w, h = region
        cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
        rows = rows.where((cx >= x) & (cx < x + w) & (cy >= y) & (cy < y + h))
        rows = rows.withColumns({"x1": F.col("x1") - x, "x2": F.col("x2") - x, "y1": F.col("y1") - y, "y2": F.col("y2") - y})
    return rows


def frame_skip(fps: float, target: float) -> int:
    """The stride that leaves about ``target`` frames a second; halves go to the even number."""
    return max(1, round(fps / max(target, 1.0)))


def detect_tiles(tiles: DataFrame, detect: Callable[[dict], Iterable[tuple[float, float, float, float, float, str]]], threshold: float = 0.45) -> DataFrame:
    """Detections of a callable that takes a tile (a row of tiles as a dictionary: video_id, frame, x, y, w, h and what else it has) and gives boxes in the tile's coordinates with confidence and class; moved to the frame, seams suppressed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out = [(t["video_id"], t["frame"], t["x"], t["y"], *(float(v) for v in d[:5]), d[5]) for t in batch.to_pylist() for d in detect(t)]
            cols = list(zip(*out, strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    names = ["video_id", "frame", "tile_x", "tile_y", "x1", "y1", "x2", "y2", "confidence", "cls"]
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), *[pa.float64()] * 5, pa.string()]
    rows = tiles.withColumns({"video_id": F.col("video_id").cast("string"), "frame": F.col("frame").cast("long"), "x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    found = rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, ["string", "long", *["double"] * 7, "string"], strict=True)))
    return merge_tiles(found, threshold)


def chaos_guard(dets: DataFrame, most: int = 40) -> DataFrame:
    """Leaves out frames with more than ``most`` detections."""
    return dets.withColumn("_n", F.count("*").over(W.partitionBy("video_id", "frame"))).where(F.col("_n") <= most).drop("_n")


def overlaps(dets: DataFrame, tile: float = 6.0) -> DataFrame:
    """One row with the pairs of boxes of a frame, their greatest and their summed overlap.

    dets: event_id, video_id, frame, x1, y1, x2, y2. Pairs are counted from the rows of each frame. Only boxes that
    meet in a square of ``tile`` are joined, and a pair counts in the square of the first corner that they share.
    """
    key = ["video_id", "frame"]
    place = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    rows = dets.where("video_id is not null and frame is not null and event_id is not null")
    # Pairs of different ids: n^2 less the squares of each id's rows, halved. places: the same for boxes that have a place.
    ids = rows.groupBy(*key, "event_id").agg(F.count("*").alias("m"), F.count_if(place).alias("p"))
    half = lambda c: F.sum(c) * F.sum(c) - F.sum(F.col(c) * F.col(c))
    counts = ids.groupBy(*key).agg((half("m") / 2).cast("long").alias("n"), (half("p") / 2).cast("long").alias("p")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("p").alias("p"))
    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    tiles = rows.where(place & (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2"))).withColumn("tx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("ty", F.explode(F.sequence(at("y1"), at("y2"))))
    a = tiles.select(*key, "tx", "ty", F.struct("event_id", "x1", "y1", "x2", "y2").alias("a"))
    met = a.join(a.withColumnRenamed("a", "b"), [*key, "tx", "ty"]).where("a.event_id < b.event_id and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2")
    first = lambda c: F.floor(F.greatest(f"a.{c}", f"b.{c}") / tile)
    o = met.where((first("x1") == F.col("tx")) & (first("y1") == F.col("ty"))).select(iou(F.col("a"), F.col("b")).alias("o"))
    got = o.agg(F.max("o").alias("max_iou"), F.sum("o").alias("sum_iou"))
    none = F.when(F.col("p") > 0, 0.0)
    return counts.crossJoin(got).select("n", F.coalesce("max_iou", none).alias("max_iou"), F.coalesce("sum_iou", none).alias("sum_iou"))


def _box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of boxes a (n, 4) with b (m, 4)."""
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.prod(np.maximum(hi - lo, 0), axis=2)
    size = lambda r: (r[:, 2] - r[:, 0]) * (r[:, 3] - r[:, 1])
    return inter / np.maximum(size(a)[:, None] + size(b)[None] - inter, 1e-9)


def nms(dets: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Per video and frame, keep detections by falling confidence that overlap no kept one by threshold or more.

    dets: video_id, frame, x1, y1, x2, y2, confidence, cls. Equal confidences go by
    box, so the result does not depend on the order of rows.
    A task walks its frames in order and holds one at a time.
    """
    cols = ["video_id", "frame", "x1", "y1", "x2", "y2", "confidence", "cls"]

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        frames = (rows for _, rows in _runs(batches, ["video_id", "frame"]))
        for rows in frames:
            box = np.stack([np.asarray(rows.column(c), float) for c in ("x1", "y1", "x2", "y2")], 1)
            gone = np.zeros(len(box), bool)
            for i in range(len(box)):
                if not gone[i] and i + 1 < len(box):
                    gone[i + 1 :] |= _box_iou(box[i : i + 1], box[i + 1 :])[0] >= threshold
            yield rows.filter(pa.array(~gone))

    kinds = ", ".join(f"`{c}` {dets.schema[c].dataType.simpleString()}" for c in cols)
    sort = ["video_id", "frame", F.desc("confidence"), "x1", "y1", "x2", "y2"]
    return dets.select(*cols).repartition("video_id", "frame").sortWithinPartitions(*sort).mapInArrow(keep, kinds)


def _runs(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterable[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of rows that come sorted by key, across batches."""
    now, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(c).to_pylist() for c in key]
        cuts = [0, *[i for i in range(1, len(batch)) if any(c[i] != c[i - 1] for c in cols)], len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = tuple(c[a] for c in cols)
            if held and k != now:
                yield now, _one(held)
                held = []
            now = k
            held.append(batch.slice(a, b - a))
    if held:
        yield now, _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def tile_windows(frames: DataFrame, tile: int = 1024, overlap: float = 0.2) -> DataFrame:
    """T-10: (video_id, x, y, w, h) tiles that cover each frame of (video_id, width, height); the last tile sticks to the edge."""
    step = max(1, int(tile * (1 - overlap)))

    def starts(size: str) -> Column:
        room = F.greatest(F.col(size) - tile, F.lit(0))
        at = F.sequence(F.lit(0).cast("long"), room.cast("long"), F.lit(step).cast("long"))
        return F.when(F.element_at(at, -1) + tile < F.col(size), F.concat(at, F.array(room.cast("long")))).otherwise(at)

    rows = frames.withColumn("y", F.explode(starts("height"))).withColumn("x", F.explode(starts("width")))
    return rows.select("video_id", "x", "y", F.least(F.lit(tile), F.col("width") - F.col("x")).alias("w"), F.least(F.lit(tile), F.col("height") - F.col("y")).alias("h"))


def merge_tiles(dets: DataFrame, threshold: float = 0.45) -> DataFrame:
    """T-10: detections in tile coordinates (with tile_x, tile_y) moved to the frame, seams suppressed."""
    moved = dets.withColumns({"x1": F.col("x1") + F.col("tile_x"), "x2": F.col("x2") + F.col("tile_x"), "y1": F.col("y1") + F.col("tile_y"), "y2": F.col("y2") + F.col("tile_y")})
    return nms(moved.drop("tile_x", "tile_y"), threshold)


def camera_shift(shifts: DataFrame) -> DataFrame:
    """Cumulative shift of (video_id, frame, dx, dy); single shifts under 0.3 px or over 120 px count as none."""
    size = F.hypot("dx", "dy")
    ok = (size >= 0.3) & (size <= 120)
    by = W.partitionBy("video_id").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return shifts.select("video_id", "frame", F.sum(F.when(ok, F.col("dx")).otherwise(0.0)).over(by).alias("cx"), F.sum(F.when(ok, F.col("dy")).otherwise(0.0)).over(by).alias("cy"))


def stabilized(points: DataFrame, shifts: DataFrame) -> DataFrame:
    """Coordinates less the cumulative shift; frames without a shift stay."""
    s = camera_shift(shifts)
    return points.join(s, ["video_id", "frame"], "left").withColumns({"x": F.col("x") - F.coalesce("cx", F.lit(0.0)), "y": F.col("y") - F.coalesce("cy", F.lit(0.0))}).drop("cx", "cy")


def motion_colour(series: Column, decay: tuple[float, ...] = (0.6, 0.25, 0.08), gain: float = 1.0) -> Column:
    """T-5, T-12: for an array of brightness over time, an array of (fast, medium, slow) decaying averages of its changes, 0 to 255."""
    start = F.struct(F.lit(None).cast("double").alias("prev"), *[F.lit(0.0).alias(f"e{i}") for i in range(len(decay))], F.array().cast(f"array<struct<{','.join(f'c{i}:int' for i in range(len(decay)))}>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        change = F.coalesce(F.abs(x - acc["prev"]), F.lit(0.0))
        now = [(1 - a) * acc[f"e{i}"] + a * change for i, a in enumerate(decay)]
        colour = F.struct(*[F.greatest(F.lit(0.0), F.least(F.lit(255.0), e * gain)).cast("int").alias(f"c{i}") for i, e in enumerate(now)])
        return F.struct(x.alias("prev"), *[e.alias(f"e{i}") for i, e in enumerate(now)], F.concat(acc["out"], F.array(colour)).alias("out"))

    return F.aggregate(series, start, step, lambda acc: acc["out"])


def lag_colour(rows: DataFrame, skip: int, key: str = "video_id", order: str = "frame", value: str = "v") -> DataFrame:
    """T-5, sequential: absolute differences to skip, 2 skip and 3 skip samples before; 0 until there are as many."""
    by = W.partitionBy(key).orderBy(order)
    return rows.withColumns({f"c{i}": F.coalesce(F.abs(F.col(value) - F.lag(value, i * skip).over(by)), F.lit(0.0)) for i in (1, 2, 3)})


# --- trackers -----------------------------------------------------------------


@dataclass
class TrackerSettings:
    high: float = 0.5
    low: float = 0.15
    jump: float = 60.0
    gap: int = 8
    fill: int = 4
    margin: float = 12.0
    iou_bonus: float = 30.0
    softness: float = 25.0
    merge: float = 18.0


@dataclass
class Track:
    number: int
    points: list[tuple] = field(default_factory=list)  # frame, x, y, w, h, conf, assoc, state
    velocity: np.ndarray = field(default_factory=lambda: np.zeros(2))
    parent: int | None = None
    ended: str = "open"
    missed: int = 0

    @property
    def frame(self) -> int:
        return self.points[-1][0]

    @property
    def place(self) -> np.ndarray:
        return np.array(self.points[-1][1:3])

    def expected(self, frame: int) -> np.ndarray:
        """Where it should be, its velocity fading with every missed frame."""
        ahead = frame - self.frame
        return self.place + self.velocity * ahead * 0.9 ** max(ahead - 1, 0)

    @property
    def rank(self) -> tuple:
        """An order of open tracks that follows from what they do next alone, so that a walk may begin anywhere; equal ones by number."""
        return (*self.points[-1][:6], *self.velocity.tolist(), self.missed, self.number)


class GreedyTracker:
    """T-1: every live track, the latest first, takes the nearest free detection within the jump per frame."""

    def __init__(self, jump: float = 60.0, gap: int = 0, chaos: int = 40):
        self.jump, self.gap, self.chaos = jump, gap, chaos
        self.tracks: list[Track] = []
        self.born = 0

    def step(self, frame: int, dets: np.ndarray) -> None:
        """dets: rows of x, y, w, h, confidence. A frame with too many is left out."""
        if len(dets) > self.chaos:
            return
        free = np.ones(len(dets), bool)
        live = [t for t in self.tracks if 0 < frame - t.frame <= self.gap + 1]
        for t in sorted(live, key=lambda t: (-t.frame, t.rank)):
            if not free.any():
                break
            d = np.where(free, np.hypot(*(dets[:, :2] - t.place).T), np.inf)
            j = int(d.argmin())
            if d[j] <= self.jump * (frame - t.frame):
                t.points.append((frame, *dets[j], 1.0, "observed"))
                free[j] = False
        for j in np.flatnonzero(free):
            self.tracks.append(Track(self.born, [(frame, *dets[j], 1.0, "observed")]))
            self.born += 1

    def skipped(self, before: int, frame: int) -> None:
        """Frames without detections need no step: the gate grows with the gap."""

    def closed(self, frame: int) -> list[Track]:
        """Takes out the tracks that nothing behind frame can continue."""
        over = [t for t in self.tracks if frame - t.frame > self.gap]
        self.tracks = [t for t in self.tracks if frame - t.frame <= self.gap]
        return over

    def live(self) -> list[Track]:
        return sorted(self.tracks, key=lambda t: t.rank)

    def resume(self, tracks: list[Track]) -> None:
        self.tracks = tracks

    def finish(self) -> list[Track]:
        out, self.tracks = self.tracks, []
        return out


class TwoStageTracker:
    """T-2: confident detections first, then faint ones; a doubtful identity ends the track instead of guessing.

    A track is doubtful if its second-best detection costs nearly as little as the
    best, or another track took its best one, or several tracks meet at one detection.
    Each unassigned confident detection starts one track; one that was contested
    inherits the velocity and the number of the track that lost it.
    """

    def __init__(self, settings: TrackerSettings | None = None):
        self.s, self.open, self.done, self.born = settings or TrackerSettings(), [], [], 0

    def _costs(self, tracks: list[Track], frame: int, dets: np.ndarray) -> np.ndarray:
        """Distance to the expected place less a bonus for overlap; infinite beyond the gate."""
        if not tracks or not len(dets):
            return np.full((len(tracks), len(dets)), np.inf)
        want = np.stack([t.expected(frame) for t in tracks])
        d = np.hypot(*(want[:, None] - dets[None, :, :2]).transpose(2, 0, 1))
        gate = self.s.jump * np.array([max(frame - t.frame, 1) for t in tracks])[:, None]
        box = lambda p: np.concatenate([p[:, :2] - p[:, 2:4] / 2, p[:, :2] + p[:, 2:4] / 2], 1)
        last = np.array([t.points[-1][1:5] for t in tracks], float)
        cost = np.maximum(d - self.s.iou_bonus * _box_iou(box(last), box(dets[:, :4])), 0)
        return np.where(d > gate, np.inf, cost)

    def _match(self, cost: np.ndarray) -> tuple[dict[int, int], dict[int, tuple[int, str]]]:
        """Assignments by track, and doubtful tracks with their detection and why."""
        taken: dict[int, int] = {}
        doubtful: dict[int, tuple[int, str]] = {}
        if not cost.size:
            return taken, doubtful
        best = cost.argmin(1)
        for t in np.argsort(cost.min(1), kind="stable"):
            row, j = cost[t], int(best[t])
            if not np.isfinite(row[j]):
                continue
            rest = np.delete(row, j)
            if j in taken.values():
                doubtful[int(t)] = (j, "merge")
            elif len(rest) and rest.min() - row[j] < self.s.margin:
                doubtful[int(t)] = (j, "competition")
            else:
                taken[int(t)] = j
        return taken, doubtful

    def _end(self, t: Track, why: str) -> None:
        t.ended = why
        self.done.append(t)
        self.open = [o for o in self.open if o is not t]

    def _extend(self, t: Track, frame: int, det: np.ndarray, cost: float) -> None:
        assoc = min(1.0, max(math.exp(-cost / self.s.softness), 0.05))
        a, ahead = t.points[-1], frame - t.frame
        if 1 < ahead <= self.s.fill:
            for k in range(1, ahead):
                t.points.append((a[0] + k, *(np.array(a[1:3]) + (det[:2] - np.array(a[1:3])) * k / ahead), a[3], a[4], 0.0, assoc * 0.5, "interpolated"))
        t.velocity = (det[:2] - np.array(a[1:3])) / max(ahead, 1)
        t.points.append((frame, *det, assoc, "observed"))
        t.missed = 0

    def step(self, frame: int, dets: np.ndarray) -> None:
        s = self.s
        high, low = dets[dets[:, 4] >= s.high], dets[(dets[:, 4] >= s.low) & (dets[:, 4] < s.high)]
        tracks = self.live()
        cost = self._costs(tracks, frame, high)
        taken, doubtful = self._match(cost)
        contested: dict[int, Track] = {}
        for t, (j, why) in doubtful.items():
            self._end(tracks[t], why)
            if j not in taken.values():
                contested[j] = tracks[t]
        for t, j in taken.items():
            self._extend(tracks[t], frame, high[j], cost[t, j])
        free = [j for j in range(len(high)) if j not in taken.values()]
        idle = [t for t in self.live() if t.frame != frame]
        for j in free:
            near = [t for t in idle if np.hypot(*(t.expected(frame) - high[j, :2])) <= s.merge]
            if len(near) >= 2:
                for t in near:
                    self._end(t, "merge")
                idle = [t for t in idle if t not in near]
        faint = self._costs(idle, frame, low)
        for t, j in self._match(faint)[0].items():
            self._extend(idle[t], frame, low[j], faint[t, j])
        for t in [t for t in self.open if t.frame != frame]:
            t.missed += 1
            if t.missed > s.gap:
                self._end(t, "lost")
        for j in free:
            lost = contested.get(j)
            new = Track(self.born, [(frame, *high[j], 1.0, "observed")], lost.velocity.copy() if lost else np.zeros(2), lost.number if lost else None)
            self.born += 1
            self.open.append(new)

    def skipped(self, before: int, frame: int) -> None:
        """Frames between two with detections: tracks miss them, and are lost after as many as the gap."""
        for missed in range(before + 1, min(frame, before + self.s.gap + 2)):
            self.step(missed, np.empty((0, 5)))

    def closed(self, frame: int) -> list[Track]:
        """Takes out the tracks that have ended."""
        out, self.done = self.done, []
        return out

    def live(self) -> list[Track]:
        return sorted(self.open, key=lambda t: t.rank)

    def resume(self, tracks: list[Track]) -> None:
        self.open = tracks

    def finish(self) -> list[Track]:
        for t in list(self.open):
            self._end(t, "end")
        return sorted(self.done, key=lambda t: t.number)


POINTS = "video_id string, track long, parent long, ended string, frame long, x double, y double, w double, h double, confidence double, association double, state string"


def track_points(video: str | None, tracks: Iterable[Track]) -> pd.DataFrame:
    rows = [(video, t.number, t.parent, t.ended, *p) for t in tracks for p in t.points]
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in POINTS.split(", ")])
    for c, kind in (c.split() for c in POINTS.split(", ")):
        out[c] = out[c].astype({"long": "Int64", "double": "float64", "string": "string"}[kind])
    return out


def detections_array(rows: pd.DataFrame | pa.RecordBatch | np.ndarray) -> np.ndarray:
    """Centre, size and confidence, in an order that does not depend on the rows'."""
    of = (lambda c: rows.column(c).to_numpy(zero_copy_only=False)) if isinstance(rows, pa.RecordBatch) else rows.__getitem__
    x1, y1, x2, y2, confidence = (np.asarray(of(c), float) for c in ("x1", "y1", "x2", "y2", "confidence"))
    out = np.stack([(x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1, confidence], 1)
    return out[np.lexsort(out.T[::-1])]


def tracker(method: str, settings: TrackerSettings | None = None, greedy: dict | None = None) -> GreedyTracker | TwoStageTracker:
    return GreedyTracker(**(greedy or {})) if method == "greedy" else TwoStageTracker(settings)


def track(dets: DataFrame, method: str = "two-stage", settings: TrackerSettings | None = None, greedy: dict | None = None) -> DataFrame:
    """T-1, T-2, T-3, T-4, T-7, T-11: points of the tracks of each video, POINTS.

    dets: video_id, frame, x1, y1, x2, y2, confidence. Frames without detections make
    tracks coast only up to the next frame that has some, then count as missed. A
    task walks its videos frame by frame; it holds the open tracks alone, and hands on
    each track once it has ended, so videos may be of any length.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        video, t, before, ended = None, None, None, []

        def points() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(track_points(video, ended), preserve_index=False)

        for (name, frame), rows in _runs(batches, ["video_id", "frame"]):
            if name != video or t is None:
                if t is not None:
                    ended += t.finish()
                    yield points()
                video, t, before, ended = name, tracker(method, settings, greedy), None, []
            if before is not None:
                t.skipped(before, frame)
            t.step(frame, detections_array(rows))
            before = frame
            ended += t.closed(frame)
            if len(ended) >= 256:
                yield points()
                ended = []
        if t is not None:
            ended += t.finish()
            yield points()

    rows = dets.select(F.col("video_id").cast("string").alias("video_id"), F.col("frame").cast("long").alias("frame"), "x1", "y1", "x2", "y2", "confidence")
    return rows.repartition("video_id").sortWithinPartitions("video_id", "frame").mapInArrow(run, POINTS)


def episodes_of(points: DataFrame, fps: float, min_s: float = 3.0, max_s: float = 120.0, max_filled: float = 0.5) -> DataFrame:
    """Tracks long and certain enough to be episodes, with quality columns and flags.

    A track is faint if its mean confidence to nine digits is under a half: what is behind them hangs on the order of a sum.
    """
    seen = F.col("state") == "observed"
    g = points.groupBy("video_id", "track").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n"), F.count_if(seen).alias("observed"), F.avg(F.when(seen, F.col("confidence"))).alias("mean_confidence"),
        F.avg("association").alias("tracking_confidence"), F.first("ended").alias("ended"), F.avg(F.when(seen, F.col("w"))).alias("w"), F.avg(F.when(seen, F.col("h"))).alias("h"),
    )
    span = F.col("end_frame") - F.col("start_frame")
    g = g.withColumns({"duration_s": span / fps, "coverage": F.col("n") / (span + 1), "filled": 1 - F.col("observed") / F.col("n"), "w": F.coalesce("w", F.lit(6.0)), "h": F.coalesce("h", F.lit(6.0))})
    g = g.where((F.col("observed") >= 2) & (F.col("duration_s") >= min_s) & (F.col("duration_s") <= max_s) & (F.col("filled") <= max_filled))
    flags = F.array_compact(F.array(F.when(F.col("coverage") < 0.9, "gaps"), F.when(F.round("mean_confidence", 9) < 0.5, "faint"), F.when(F.col("ended").isin("merge", "competition"), F.concat(F.lit("ended_by_"), F.col("ended")))))
    return g.withColumns({"flags": flags, "episode_id": F.concat(F.lit("ep_"), F.substring(F.sha2(F.concat_ws("|", "video_id", "track", "start_frame"), 256), 1, 12))})


def quality_gate(frames: DataFrame, dets: DataFrame, episodes: DataFrame, fps: float, min_s: float = 3.0) -> DataFrame:
    """P10: status and reason for each video of frames (video_id, frame)."""
    n = frames.groupBy("video_id").agg(F.count_distinct("frame").alias("frames"))
    d = dets.groupBy("video_id").agg(F.count_distinct("frame").alias("with_dets"), F.avg("confidence").alias("mean_conf"))
    e = episodes.groupBy("video_id").agg(F.count("*").alias("episodes"))
    r = n.join(d, "video_id", "left").join(e, "video_id", "left").fillna(0, ["with_dets", "episodes"])
    why = F.when((F.col("frames") >= 10) & (F.col("with_dets") / F.col("frames") < 0.02), "no detections").when(F.col("mean_conf") < 0.2, "faint detections").when((F.col("frames") / fps >= min_s) & (F.col("episodes") == 0), "no episodes")
    return r.withColumns({"status": F.when(why.isNull(), "ok").otherwise("failed"), "reason": why})


def run_stats(points: DataFrame) -> DataFrame:
    """Tracks of each video and the upper median of their lengths, from how many tracks have each length."""
    n = points.groupBy("video_id", "track").agg(F.count("*").alias("n"))
    per = n.groupBy("video_id", "n").agg(F.count("*").alias("t"))
    by = W.partitionBy("video_id")
    upto = per.withColumns({"upto": F.sum("t").over(by.orderBy("n").rowsBetween(W.unboundedPreceding, 0)), "tracks": F.sum("t").over(by)})
    middle = F.floor(F.col("tracks") / 2)
    return upto.groupBy("video_id", "tracks").agg(F.min(F.when(F.col("upto") > middle, F.col("n"))).alias("median_length"))


# --- ground truth -------------------------------------------------------------


def truth_points(waypoints: DataFrame, hidden: DataFrame, fps: float, seconds: float) -> DataFrame:
    """(scene, animal, frame, x, y) on piecewise-linear paths, clamped at their ends, without hidden spans."""
    by = W.partitionBy("scene", "animal").orderBy("t_s")
    legs = waypoints.withColumns({"t1": F.lead("t_s").over(by), "x1": F.lead("x").over(by), "y1": F.lead("y").over(by), "is_first": F.row_number().over(by) == 1})
    last = int(seconds * fps)
    lo = F.when(F.col("is_first"), 0).otherwise(F.ceil(F.col("t_s") * fps)).cast("long")
    hi = F.when(F.col("t1").isNull(), last - 1).otherwise(F.least(F.lit(last - 1), F.ceil(F.col("t1") * fps) - 1)).cast("long")
    rows = legs.where(lo <= hi).withColumn("frame", F.explode(F.sequence(lo, hi)))
    t = F.col("frame") / fps
    share = F.when(F.col("t1").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (t - F.col("t_s")) / F.greatest(F.col("t1") - F.col("t_s"), F.lit(1e-9))))
    at = lambda a, b: F.col(a) + share * (F.coalesce(F.col(b), F.col(a)) - F.col(a))
    pts = rows.select("scene", "animal", "frame", at("x", "x1").alias("x"), at("y", "y1").alias("y"))
    h = hidden.select(F.col("scene").alias("hs"), F.col("animal").alias("ha"), "t0_s", F.col("t1_s"))
    gone = (F.col("scene") == F.col("hs")) & (F.col("animal") == F.col("ha")) & (F.col("frame") / fps >= F.col("t0_s")) & (F.col("frame") / fps <= F.col("t1_s"))
    return pts.join(F.broadcast(h), gone, "left_anti")


def match_truth(points: DataFrame, truth: DataFrame) -> DataFrame:
    """Per track (scene, track) the animal most of its points are nearest to, purity and mean error."""
    from .cells import nearest_in_frame  # it takes this module's runs

    near = nearest_in_frame(points, truth.select("scene", "frame", "animal", F.col("x").alias("tx"), F.col("y").alias("ty")))
    votes = near.groupBy("scene", "track", "animal").agg(F.count("*").alias("n"), F.avg("d").alias("error"))
    best = votes.groupBy("scene", "track").agg(F.max_by(F.struct("animal", "n", "error"), F.struct("n", F.expr("-error"))).alias("b"), F.sum("n").alias("total"))
    return best.select("scene", "track", "b.animal", (F.col("b.n") / F.col("total")).alias("purity"), "b.error")


def benchmark_cost(matched: DataFrame, truth: DataFrame, episodes: DataFrame, fps: float, pure: float = 0.95) -> DataFrame:
    """False merges, extra fragments, usable recall and 5 * merges + 0.5 * fragments + (1 - recall)."""
    scenes = truth.groupBy("scene").agg(F.count_distinct("animal").alias("animals"), (F.count("*") / fps).alias("moved_s"))
    e = matched.join(episodes.select("scene", "track", "duration_s"), ["scene", "track"])
    per = e.groupBy("scene").agg(F.count("*").alias("n"), F.count_if(F.col("purity") < 0.9).alias("mixed"), F.sum(F.when(F.col("purity") >= pure, F.col("duration_s")).otherwise(0.0)).alias("usable_s"))
    r = scenes.join(per, "scene", "left").fillna(0)
    m = r.agg((F.sum("mixed") / F.greatest(F.sum("n"), F.lit(1))).alias("false_merge_rate"), F.avg(F.greatest(F.col("n") - F.col("animals"), F.lit(0))).alias("fragmentation"), (F.sum("usable_s") / F.greatest(F.sum("moved_s"), F.lit(1e-9))).alias("recall"))
    return m.withColumn("cost", 5 * F.col("false_merge_rate") + 0.5 * F.col("fragmentation") + (1 - F.col("recall")))
