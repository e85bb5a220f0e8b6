"""Kinematic features of trajectories and speed series, by windows over samples.

Everything of one episode stays in one hash partition: the first window shuffles by
episode_id, all later windows and aggregates reuse that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import wrap_angle
from ..schema import FEATURES



def episode() -> WindowSpec:
    return W.partitionBy("episode_id")


def finite(samples: DataFrame) -> DataFrame:
    """Samples with both coordinates."""
    return samples.where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def _islands(rows: DataFrame, order: str, flag: str) -> DataFrame:
    """Gaps and islands: run numbers runs of equal flag within an episode."""
    by = episode().orderBy(order)
    return rows.withColumn("change", F.when(F.lag(flag).over(by) == F.col(flag), 0).otherwise(1)).withColumn("run", F.sum("change").over(by.rowsBetween(W.unboundedPreceding, 0)))


def run_lengths(rows: DataFrame, order: str, flag: str) -> DataFrame:
    """episode_id, run, moving, n of every run of moving or resting samples."""
    return _islands(rows, order, flag).groupBy("episode_id", "run").agg(F.first(flag).alias("moving"), F.count("*").alias("n"))


def moving_flags(velocity: DataFrame) -> DataFrame:
    """Adds dv, the episode's 90th percentile and moving, speed over a tenth of the median (of at least 1e-9).

    The ordered window comes first, so one sort by (episode, i) serves all windows.
    """
    rows = velocity.withColumn("dv", F.col("v") - F.lag("v").over(episode().orderBy("i")))
    rows = rows.withColumn("_p", F.percentile("v", F.array(F.lit(0.5), F.lit(0.9))).over(episode()))
    return rows.withColumns({"moving": F.col("v") > 0.1 * F.greatest(F.col("_p")[0], F.lit(1e-9)), "p90": F.col("_p")[1]}).drop("_p")


def _speed_stats(rows: DataFrame, order: str) -> DataFrame:
    """What speed alone tells, for rows with v, dv, p90 and moving: aggregates per episode over its runs."""
    rows = _islands(rows, order, "moving")
    per_run = rows.groupBy("episode_id", "run").agg(
        F.first("moving").alias("moving"), F.count("*").alias("n"), F.sum("v").alias("sv"), F.sum(F.col("v") * F.col("v")).alias("svv"), F.sum(F.col("dv") * F.col("dv")).alias("sdd"), F.count("dv").alias("nd"), F.first("p90").alias("p90"),
    )
    n, mean = F.sum("n"), F.sum("sv") / F.sum("n")
    spread = F.sqrt(F.greatest(F.sum("svv") / n - mean * mean, F.lit(0.0)))
    return per_run.groupBy("episode_id").agg(
        n.alias("n"), F.sum("sv").alias("sum_v"), mean.alias("speed_mean"), F.when(mean > 0, spread / mean).otherwise(0.0).alias("speed_cv"), F.first("p90").alias("speed_p90"),
        F.when(F.sum("nd") > 0, F.sqrt(F.sum("sdd") / F.sum("nd"))).otherwise(0.0).alias("dv_rms"),
        (F.sum(F.when(F.col("moving"), F.col("n")).otherwise(0)) / n).alias("frac_time_moving"),
        F.count_if(~F.col("moving")).cast("double").alias("n_pauses"),
        F.coalesce(F.avg(F.when(~F.col("moving"), F.col("n"))), F.lit(0.0)).alias("pause_run"), F.coalesce(F.avg(F.when(F.col("moving"), F.col("n"))), F.lit(0.0)).alias("move_run"),
    )


def velocity_features(velocity: DataFrame, fps: float = 100.0, compat: bool = False) -> DataFrame:
    """A2: the sixteen features of speed series (episode_id, i, v), in one shuffle.

    Directional features are 0. With compat the two pause features are 0 as well, as
    the published implementation has them. Null speeds are left out.
    """
    s = _speed_stats(moving_flags(velocity.where("v is not null")), "i")
    zero = F.lit(0.0)
    return s.select(
        "episode_id", (F.col("dv_rms") * fps).alias("accel_rms"), zero.alias("curvature_mean"), (F.col("sum_v") / fps).alias("distance"), (F.col("n") / fps).alias("duration_s"), "frac_time_moving",
        (F.col("move_run") / fps).alias("move_run_mean_s"), (zero if compat else F.col("n_pauses")).alias("n_pauses"), (F.col("sum_v") / fps).alias("net_displacement"),
        (zero if compat else F.col("pause_run") / fps).alias("pause_run_mean_s"), zero.alias("sinuosity"), "speed_cv", "speed_mean", "speed_p90", zero.alias("straightness_index"), zero.alias("turn_rate_mean"), zero.alias("turn_rate_p90"),
    )


def modal_step(samples: DataFrame) -> DataFrame:
    """episode_id and step, the most frequent frame delta; the smallest of equally frequent ones, 1 without any."""
    by = episode().orderBy("frame")
    deltas = samples.select("episode_id", (F.col("frame") - F.lag("frame").over(by)).alias("delta"))
    counted = deltas.groupBy("episode_id", "delta").agg(F.count("*").alias("n"))
    return counted.groupBy("episode_id").agg(F.coalesce(F.min_by("delta", F.when(F.col("delta").isNotNull(), F.struct(-F.col("n"), "delta"))), F.lit(1)).alias("step"))


def steps(samples: DataFrame, fps: Column | None = None, strict: bool = False, wrap: bool = True) -> DataFrame:
    """Per sample the step from the one before, its validity, speed, heading and turn.

    A step is valid if its frame delta is the modal one, or (not strict) within a quarter
    of it, at least 1. Turns need two valid steps in a row. wrap takes the short way round.
    """
    by = episode().orderBy("frame")
    rate = fps if fps is not None else F.col("fps")
    rows = finite(samples).join(modal_step(finite(samples)), "episode_id").withColumn("dt", F.col("step") / rate)
    rows = rows.withColumns({"delta": F.col("frame") - F.lag("frame").over(by), "dx": F.col("x") - F.lag("x").over(by), "dy": F.col("y") - F.lag("y").over(by)})
    off = F.abs(F.col("delta") - F.col("step"))
    valid = off == 0 if strict else off <= F.greatest(F.lit(1), F.bround(F.col("step") * 0.25))
    rows = rows.withColumns({"len": F.hypot("dx", "dy"), "valid": F.coalesce(valid, F.lit(False)), "heading": F.atan2("dy", "dx")})
    rows = rows.withColumn("v", F.when(F.col("valid"), F.try_divide("len", "dt")))
    turn = F.col("heading") - F.lag("heading").over(by)
    both = F.col("valid") & F.lag("valid").over(by)
    return rows.withColumn("turn", F.when(both, wrap_angle(turn) if wrap else turn))


def trajectory_features(samples: DataFrame, compat: bool = False) -> DataFrame:
    """A1: the sixteen features of tracks (episode_id, frame, x, y, fps, px_per_cm).

    Documented meaning by default: turns take the short way round and pauses are
    counted. compat gives what the published implementation returns: turns as plain
    differences, pauses 0. Episodes of fewer than two finite samples have zeros. Lengths are
    in centimetres where px_per_cm is known, otherwise in pixels.
    """
    scale = F.when(F.col("px_per_cm") > 0, F.col("px_per_cm")).otherwise(1.0)
    everyone = samples.groupBy("episode_id").agg(F.first("fps", True).alias("fps"))
    scaled = samples.withColumns({"x": F.col("x") / scale, "y": F.col("y") / scale})
    rows = steps(scaled, wrap=not compat)
    geometry = rows.groupBy("episode_id").agg(
        F.count("*").alias("points"), F.first("dt").alias("dt"), F.min_by(F.struct("x", "y"), "frame").alias("a"), F.max_by(F.struct("x", "y"), "frame").alias("b"),
        F.sum(F.when(F.col("valid"), F.col("len"))).alias("path"), F.avg(F.try_divide(F.abs("turn"), F.col("dt"))).alias("turn_rate_mean"), F.percentile(F.try_divide(F.abs("turn"), F.col("dt")), 0.9).alias("turn_rate_p90"),
        F.avg(F.abs("turn") / F.greatest("len", F.lit(1e-9))).alias("curvature_mean"),
    ).where("points >= 2")
    kept = rows.where("valid").withColumn("dv", F.col("v") - F.lag("v").over(episode().orderBy("frame")))
    kept = kept.withColumn("_p", F.percentile("v", F.array(F.lit(0.5), F.lit(0.9))).over(episode()))
    kept = kept.withColumns({"moving": F.col("v") > F.greatest(0.1 * F.col("_p")[0], F.lit(1e-9)), "p90": F.col("_p")[1]})
    speed = _speed_stats(kept, "frame")
    g = everyone.join(geometry, "episode_id", "left").join(speed, "episode_id", "left")
    net = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    path = F.coalesce("path", F.lit(0.0))
    value = {
        "accel_rms": F.try_divide("dv_rms", "dt"), "curvature_mean": F.col("curvature_mean"), "distance": path, "duration_s": F.col("points") * F.col("dt"), "frac_time_moving": F.col("frac_time_moving"),
        "move_run_mean_s": F.col("move_run") / F.col("fps"), "n_pauses": F.lit(0.0) if compat else F.col("n_pauses"), "net_displacement": net, "pause_run_mean_s": F.lit(0.0) if compat else F.col("pause_run") / F.col("fps"),
        "sinuosity": path / F.greatest(net, F.lit(1e-9)), "speed_cv": F.col("speed_cv"), "speed_mean": F.col("speed_mean"), "speed_p90": F.col("speed_p90"), "straightness_index": net / F.greatest(path, F.lit(1e-9)),
        "turn_rate_mean": F.col("turn_rate_mean"), "turn_rate_p90": F.col("turn_rate_p90"),
    }
    return g.select("episode_id", *[F.when(F.col("points").isNull(), 0.0).otherwise(F.coalesce(value[f], F.lit(0.0))).alias(f) for f in FEATURES])


def feature_matrix(features: DataFrame, *keep: str) -> DataFrame:
    """A3: episode_id, the columns ``keep``, and the features as one vector, in the order of their names."""
    return features.select("episode_id", *keep, F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES]).alias("z"))


def frame_speed_heading(samples: DataFrame) -> DataFrame:
    """Speed by the true gap and heading of each frame; the first frame takes those of the next.

    A step without motion has no heading; that frame takes the heading of the very next step only.
    """
    by = episode().orderBy("frame")
    rows = finite(samples).withColumns({"gap": (F.col("frame") - F.lag("frame").over(by)) / F.col("fps"), "dx": F.col("x") - F.lag("x").over(by), "dy": F.col("y") - F.lag("y").over(by)})
    length = F.hypot("dx", "dy")
    rows = rows.withColumns({"v_in": F.when(F.col("gap") > 0, length / F.col("gap")), "h_in": F.when(length > 1e-9, F.atan2("dy", "dx"))})
    return rows.withColumns({"speed": F.coalesce("v_in", F.lead("v_in").over(by)), "heading": F.coalesce("h_in", F.lead("h_in").over(by))}).drop("gap", "dx", "dy", "v_in", "h_in")


def resample(rows: DataFrame, order: str, points: int) -> DataFrame:
    """At most ``points`` rows of each episode, evenly by position, first and last included."""
    n = F.count("*").over(episode())
    rows = rows.withColumns({"pos": F.row_number().over(episode().orderBy(order)) - 1, "n": n})
    # Position p stands for some i of 0..m-1 with floor(i * (n-1) / (m-1)) = p.
    last, m = F.col("n") - 1, max(points - 1, 1)
    i = F.ceil(F.col("pos") * m / F.when(last > 0, last)).cast("long")
    hit = (F.col("n") <= points) | (F.floor(i * last / m) == F.col("pos"))
    return rows.where(hit if points > 1 else F.col("pos") == 0).drop("pos", "n")


def scalar_series(velocity: DataFrame, points: int = 160) -> DataFrame:
    """(episode_id, i, speed, turn, moving) of speed series at ``points`` even places at most; a speed series has no turn."""
    moving = F.col("v") > 0.1 * F.greatest(F.median("v").over(episode()), F.lit(1e-9))
    rows = resample(velocity.withColumn("moving", F.when(moving, 1.0).otherwise(0.0)), "i", points)
    return rows.select("episode_id", "i", F.round("v", 4).alias("speed"), F.lit(0.0).alias("turn"), "moving")


def track_series(samples: DataFrame, points: int = 160) -> DataFrame:
    """The same of tracks: speed and turn of each step by the true gap."""
    rows = frame_speed_heading(samples)
    turn = F.coalesce(F.abs(wrap_angle(F.col("heading") - F.lag("heading").over(episode().orderBy("frame")))), F.lit(0.0))
    rows = rows.withColumns({"v": F.coalesce("speed", F.lit(0.0)), "turn": turn, "i": F.col("frame")})
    moving = F.col("v") > 0.1 * F.greatest(F.median("v").over(episode()), F.lit(1e-9))
    rows = resample(rows.withColumn("moving", F.when(moving, 1.0).otherwise(0.0)), "i", points)
    return rows.select("episode_id", "i", F.round("v", 4).alias("speed"), F.round("turn", 4).alias("turn"), "moving")


def median_step(samples: DataFrame) -> DataFrame:
    """The median of an episode's positive frame steps, 1 without any."""
    step = F.col("frame") - F.lag("frame").over(episode().orderBy("frame"))
    return finite(samples).withColumn("d", step).groupBy("episode_id").agg(F.coalesce(F.median(F.when(F.col("d") > 0, F.col("d"))), F.lit(1.0)).alias("step"))


def sliding_windows(velocity: DataFrame, fps: float = 100.0, window_s: float = 3.0, stride_s: float = 1.0, least: int = 10, **kw) -> DataFrame:
    """Velocity features of overlapping stretches, by window number; episodes too short for one are one window."""
    width, stride = int(window_s * fps), max(int(stride_s * fps), 1)
    rows = velocity.withColumns({"pos": F.row_number().over(episode().orderBy("i")) - 1, "n": F.count("*").over(episode())})
    last = F.when(F.col("n") <= width, 0).otherwise(F.floor((F.col("n") - width) / stride)).cast("long")
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - width + 1) / stride).cast("long"))
    hi = F.least(last, F.floor(F.col("pos") / stride).cast("long"))
    rows = rows.where(lo <= hi).withColumn("window", F.explode(F.sequence(lo, hi)))
    keyed = rows.select(F.struct("episode_id", "window").alias("episode_id"), "i", "v")
    enough = keyed.groupBy("episode_id").agg(F.count("*").alias("m")).where(F.col("m") >= least).drop("m")
    out = velocity_features(keyed.join(enough, "episode_id", "left_semi"), fps, **kw)
    return out.select(F.col("episode_id.episode_id").alias("episode_id"), F.col("episode_id.window").alias("window"), *FEATURES)


def shape_series(samples: DataFrame, points: int = 64) -> DataFrame:
    """Series for the shape encoder: z-scored speed and wrapped turn at ``points`` evenly spaced places, linearly interpolated.

    Short episodes are stretched, so that every series has the same length.
    """
    rows = steps(samples, strict=True).where("valid")
    rows = rows.withColumns({"k": F.row_number().over(episode().orderBy("frame")) - 1, "n": F.count("*").over(episode()), "t": F.coalesce("turn", F.lit(0.0))})
    for c in ("v", "t"):
        rows = rows.withColumn(f"z{c}", (F.col(c) - F.avg(c).over(episode())) / F.greatest(F.stddev_pop(c).over(episode()), F.lit(1e-9)))
    series = rows.groupBy("episode_id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "zv", "zt"))).alias("s"))
    place = lambda i: i * (F.col("n") - 1) / (points - 1)

    def at(name: str) -> Column:
        def one(i: Column) -> Column:
            lo = F.floor(place(i)).cast("int")
            a, b = F.get("s", lo)[name], F.get("s", F.least(lo + 1, F.col("n").cast("int") - 1))[name]
            return a + (b - a) * (place(i) - lo)

        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), one)

    return series.select("episode_id", F.concat(at("zv"), at("zt")).alias("z"))


def rotate(samples: DataFrame, theta: float) -> DataFrame:
    """M7."""
    c, s = math.cos(theta), math.sin(theta)
    return samples.withColumns({"x": F.col("x") * c - F.col("y") * s, "y": F.col("x") * s + F.col("y") * c})


def translate(samples: DataFrame, dx: float, dy: float) -> DataFrame:
    return samples.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def jitter(samples: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    return samples.withColumns({"x": F.col("x") + sigma * F.randn(seed), "y": F.col("y") + sigma * F.randn(seed + 1)})
