"""Geometry and numbers as columns; null in, null out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def wrap_angle(a: Column) -> Column:
    """Radians to [-pi, pi)."""
    return F.pmod(a + F.lit(PI), F.lit(2 * PI)) - F.lit(PI)


def heading_diff_deg(a: Column, b: Column) -> Column:
    """Absolute difference of two headings in radians, as degrees from 0 to 180."""
    return F.abs(F.degrees(wrap_angle(a - b)))


def bearing_sector(deg: Column) -> Column:
    """front up to 60 degrees, side up to 120, else rear."""
    return F.when(deg <= 60, "front").when(deg <= 120, "side").when(deg.isNotNull(), "rear")


def circular_mean_deg(deg: Column) -> Column:
    """A14, an aggregate: the mean direction in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(deg))), F.avg(F.cos(F.radians(deg))))), F.lit(360.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - _dot(a, b) / F.greatest(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(1e-12))


def similarity(distance: Column, scale: float = 3.0) -> Column:
    return F.exp(-distance / scale)


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes, structs of x1, y1, x2, y2."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-9))


def interpolate(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Linear between two points, clamped outside them."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(t - t0, t1 - t0), F.lit(0.0))))
    return v0 + share * (v1 - v0)


def decay_prediction(x: Column, velocity: Column, steps: Column, decay: float = 0.9) -> Column:
    """Coasting position: the velocity loses a tenth with every missed step."""
    return x + velocity * steps * F.pow(F.lit(decay), steps - 1)


def to_uint8(value: Column, gain: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), value * gain)).cast("int")


def population_z(value: Column, over) -> Column:
    """Z-score within a window, population spread, floored."""
    return (value - F.avg(value).over(over)) / F.greatest(F.stddev_pop(value).over(over), F.lit(1e-9))
