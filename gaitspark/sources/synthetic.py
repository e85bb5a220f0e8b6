"""Generated tracks, speed series and ground-truth scenes; every animal has a seed of its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Step scale, turn spread, chance to pause, chance to go on, chance to jump.
GAITS = {"ant": (2.2, 0.25, 0.01, 0.2, 0.0), "siler": (1.8, 0.6, 0.06, 0.08, 0.01)}


def _walk(kind: str, n: int, seed: int, width: float, height: float) -> np.ndarray:
    scale, turn, stop, go, jump = GAITS[kind]
    rng = np.random.default_rng(seed)
    place, heading, moving, out = np.array([rng.uniform(0, width), rng.uniform(0, height)]), rng.uniform(-np.pi, np.pi), True, []
    for _ in range(n):
        moving = rng.random() >= stop if moving else rng.random() < go
        if moving:
            heading += rng.normal(0, turn)
            step = scale * rng.gamma(4, 0.25) * (12 if rng.random() < jump else 1)
            place = place + step * np.array([np.cos(heading), np.sin(heading)])
            for axis, limit in ((0, width), (1, height)):
                if not 0 <= place[axis] <= limit:
                    place[axis] = min(max(2 * (0 if place[axis] < 0 else limit) - place[axis], 0), limit)
                    heading = np.pi - heading if axis == 0 else -heading
        out.append(place.copy())
    return np.array(out)


def synthetic_tracks(spark: SparkSession, animals: int, frames: int = 600, seed: int = 0, fps: float = 30.0) -> DataFrame:
    """Samples of ant- and siler-like animals in turn, ten to a scene."""
    ids = spark.range(animals)

    def make(batches):
        for pdf in batches:
            for i in pdf["id"]:
                kind = "ant" if i % 2 == 0 else "siler"
                p = _walk(kind, frames, seed * 1_000_003 + int(i), 960, 540)
                yield pd.DataFrame({"episode_id": f"e{i:06d}", "scene": f"s{i // 10}", "label": kind, "frame": np.arange(frames), "x": p[:, 0], "y": p[:, 1]})

    rows = ids.mapInPandas(make, "episode_id string, scene string, label string, frame long, x double, y double")
    return rows.withColumns({"fps": F.lit(fps), "px_per_cm": F.lit(None).cast("double")})


def synthetic_velocity(spark: SparkSession, episodes: int, samples: int = 240, seed: int = 0) -> DataFrame:
    """Gamma-distributed speeds, 20 episodes to a video."""

    def make(batches):
        for pdf in batches:
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                yield pd.DataFrame({"episode_id": f"v{i:07d}", "video_id": f"video{i // 20}", "i": np.arange(samples), "v": rng.gamma(2.0, 1.0 + (i % 3), samples)})

    return spark.range(episodes).mapInPandas(make, "episode_id string, video_id string, i long, v double")


def default_scenes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Waypoints and hidden spans of five scenes: parallel, crossing, collision, occlusion, stationary."""
    way = [
        ("parallel", "a", 0, 100, 150), ("parallel", "a", 8, 800, 150), ("parallel", "b", 0, 100, 350), ("parallel", "b", 8, 800, 350),
        ("crossing", "a", 0, 100, 100), ("crossing", "a", 8, 800, 450), ("crossing", "b", 0, 100, 450), ("crossing", "b", 8, 800, 100),
        ("collision", "a", 0, 100, 270), ("collision", "a", 4, 460, 270), ("collision", "a", 8, 100, 200), ("collision", "b", 0, 860, 270), ("collision", "b", 4, 470, 270), ("collision", "b", 8, 860, 340),
        ("occlusion", "a", 0, 100, 200), ("occlusion", "a", 8, 800, 200), ("occlusion", "b", 0, 800, 400), ("occlusion", "b", 8, 100, 400),
        ("stationary", "a", 0, 300, 300), ("stationary", "a", 8, 302, 300), ("stationary", "b", 0, 600, 100), ("stationary", "b", 8, 600, 480),
    ]
    hidden = [("occlusion", "a", 3.0, 3.2), ("occlusion", "b", 4.0, 5.0)]
    return (
        spark.createDataFrame([(s, a, float(t), float(x), float(y)) for s, a, t, x, y in way], "scene string, animal string, t_s double, x double, y double"),
        spark.createDataFrame(hidden, "scene string, animal string, t0_s double, t1_s double"),
    )
