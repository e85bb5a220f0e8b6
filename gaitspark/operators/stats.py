"""Distribution overlap, contrasts with permutation nulls, rank and transport statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .permutation import permutation_contrast  # noqa: F401

BINS = 24


def overlap(rows: DataFrame, keys: list[str], side: str = "side", value: str = "value") -> DataFrame:
    """A10: Bhattacharyya overlap of the values with side 'a' and side 'b', for each of keys.

    The shared range has 24 bins, the last of them closed; densities, so the result
    is the sum of sqrt(pa * pb) times the width. A range under 1e-12 or an empty side
    gives null.
    """
    r = rows.where(F.col(value).isNotNull())
    span = r.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(F.col(side) == "a").alias("na"), F.count_if(F.col(side) == "b").alias("nb"))
    width = (F.col("hi") - F.col("lo")) / BINS
    cell = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col(value) - F.col("lo")) / width))).cast("int")
    binned = r.join(span.where("hi - lo >= 1e-12"), keys).groupBy(*keys, "lo", "hi", "na", "nb", cell.alias("bin")).agg(F.count_if(F.col(side) == "a").alias("ca"), F.count_if(F.col(side) == "b").alias("cb"))
    part = F.sqrt(F.try_divide(F.col("ca"), F.col("na") * width) * F.try_divide(F.col("cb"), F.col("nb") * width)) * width
    got = binned.groupBy(*keys).agg(F.sum(part).alias("overlap"))
    return span.join(got, keys, "left").select(*keys, "na", "nb", F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("overlap")).alias("overlap"))


def fingerprint(features: DataFrame, dims: tuple[str, ...], label: str = "label", focal: tuple[str, ...] = ("siler", "mimic"), model: str = "ant", least: int = 3) -> DataFrame:
    """Overlap of focal and model, and of focal and everything else, on each dimension.

    A side of fewer than three episodes gives null; dimensions that are constant on
    both sides give no row.
    """
    long = features.unpivot([label], list(dims), "dim", "value")
    group = F.when(F.col(label).isin(*focal), "a").when(F.col(label) == model, "m").otherwise("o")
    long = long.withColumn("g", group)
    out = None
    for name, other in (("model", "m"), ("others", "o")):
        pair = long.where(F.col("g").isin("a", other)).withColumn("side", F.when(F.col("g") == "a", "a").otherwise("b"))
        got = overlap(pair, ["dim"]).select("dim", F.col("nb").alias(f"n_{name}"), F.when((F.col("na") >= least) & (F.col("nb") >= least), F.col("overlap")).alias(f"overlap_{name}"))
        out = got if out is None else out.join(got, "dim", "full")
    flat = long.groupBy("dim").agg((F.max("value") - F.min("value")).alias("r"))
    return out.join(flat.where("r >= 1e-12").drop("r"), "dim", "left_semi")


#: Different values of a key that one task may sort, about.
SORTED = 1_000_000


def stretches(per: DataFrame, keys: list[str]) -> int:
    """How many ranges running() needs, so that no task sorts many more values of a key than SORTED: from the largest key's count of rows in per."""
    most = per.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return -(-most // SORTED)


def running(per: DataFrame, keys: list[str], value: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """per (one row for each of keys and value) with, for each of columns, its sum over smaller values as before_<name> and over all values as total_<name>, and the next value as _next.

    With more than one range the values of a key are cut there into so many stretches, each summed up
    by a task of its own, so that no task holds a key: sums of whole stretches are few.
    None takes as many as the largest key needs.
    """
    by, ranges = W.partitionBy(*keys), stretches(per, keys) if ranges is None else ranges
    if ranges <= 1:
        run = by.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        sums = {f"before_{c}": F.coalesce(F.sum(c).over(run), F.lit(0)) for c in columns} | {f"total_{c}": F.sum(c).over(by) for c in columns}
        return per.withColumns(sums | {"_next": F.lead(value).over(by.orderBy(value))})
    cuts = per.groupBy(*keys).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"), *[F.sum(c).alias(f"total_{c}") for c in columns])
    rows = per.join(cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    parts = rows.groupBy(*keys, "_range").agg(F.min(value).alias("_least"), *[F.sum(c).alias(f"_sum_{c}") for c in columns])
    ahead = by.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*keys, "_range", F.lead("_least").over(by.orderBy("_range")).alias("_after"), *[F.coalesce(F.sum(f"_sum_{c}").over(ahead), F.lit(0)).alias(f"_ahead_{c}") for c in columns])
    within = W.partitionBy(*keys, "_range").orderBy(value)
    run = within.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(parts, [*keys, "_range"]).withColumns({f"before_{c}": F.col(f"_ahead_{c}") + F.coalesce(F.sum(c).over(run), F.lit(0)) for c in columns} | {"_next": F.coalesce(F.lead(value).over(within), F.col("_after"))})
    return rows.drop("_range", "_after", *[f"_ahead_{c}" for c in columns])


def rank_sums(rows: DataFrame, keys: list[str], value: str = "value", side: str = "side", ranges: int | None = None) -> DataFrame:
    """Mann-Whitney U of side a, by average ranks, and the sum of t^3 - t over ties. ranges: see running()."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(F.col(side) == "a").alias("a"), F.count("*").alias("t"))
    ranked = running(per, keys, value, ["t"], ranges).withColumn("rank", F.col("before_t") + (F.col("t") + 1) / 2)
    n_a = F.sum("a")
    return ranked.groupBy(*keys).agg(n_a.alias("n_a"), (F.sum("t") - n_a).alias("n_b"), (F.sum(F.col("rank") * F.col("a")) - n_a * (n_a + 1) / 2).alias("u"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))


def u_pvalue(n_a: int, n_b: int, u: float, ties: float) -> float:
    """Two-sided p: exact without ties where the smaller side has 8 or fewer, else the normal limit with continuity and tie corrections."""
    if not n_a or not n_b:
        return float("nan")
    if not ties and min(n_a, n_b) <= 8:
        ways = np.zeros(n_a * n_b + 1)
        ways[0] = 1
        for i in range(1, n_a + 1):  # Gaussian binomial, factor by factor
            top = n_b + i
            for s in range(n_a * n_b, top - 1, -1):
                ways[s] -= ways[s - top]
            for s in range(i, n_a * n_b + 1):
                ways[s] += ways[s - i]
        tail = ways[: int(min(u, n_a * n_b - u)) + 1].sum() / ways.sum()
        return float(min(1.0, 2 * tail))
    n = n_a + n_b
    var = n_a * n_b / 12 * (n + 1 - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (abs(u - n_a * n_b / 2) - 0.5) / math.sqrt(var)
    return float(min(1.0, math.erfc(max(z, 0.0) / math.sqrt(2))))


def mann_whitney(rows: DataFrame, keys: list[str], **kw) -> DataFrame:
    """rank_sums with p_value."""
    got = rank_sums(rows, keys, **kw)

    def p(batches):
        for pdf in batches:
            pdf["p_value"] = [u_pvalue(int(a), int(b), float(u), float(t)) for a, b, u, t in zip(pdf.n_a, pdf.n_b, pdf.u, pdf.ties, strict=True)]
            yield pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in got.schema.fields)
    return got.mapInPandas(p, f"{kinds}, p_value double")


def wasserstein(rows: DataFrame, keys: list[str], value: str = "value", side: str = "side", ranges: int | None = None) -> DataFrame:
    """One-dimensional transport distance between sides a and b, by the gap of their distribution functions. ranges: see running()."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(F.col(side) == "a").alias("a"), F.count_if(F.col(side) != "a").alias("b"))
    share = lambda c: F.try_divide(F.col(f"before_{c}") + F.col(c), F.col(f"total_{c}"))
    part = running(per, keys, value, ["a", "b"], ranges).withColumn("part", F.abs(share("a") - share("b")) * (F.col("_next") - F.col(value)))
    return part.groupBy(*keys).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("w1"))
