"""Standardisation, principal components, k-means and their projections.

Fits gather sums only: a Gram matrix of at most a few hundred dimensions, or k
centres, comes to the driver; rows never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .wide import leading


@dataclass
class Projection:
    """M1, M2: mean, spread and components (k rows), with the share of variance of each."""

    mean: np.ndarray
    spread: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def checksum(self) -> str:
        """M5: of the weights' bytes, 16 hexadecimal digits."""
        return hashlib.sha256(b"".join(np.ascontiguousarray(a, np.float64).tobytes() for a in (self.mean, self.spread, self.components))).hexdigest()[:16]

    def transform(self, z: Column, digits: int | None = None) -> Column:
        """M6: the projected vector of an array column."""
        scaled = F.zip_with(F.zip_with(z, _lit(self.mean), lambda a, b: a - b), _lit(self.spread), lambda a, b: a / b)
        dots = [F.aggregate(F.zip_with(scaled, _lit(c), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for c in self.components]
        return F.array(*[F.bround(d, digits) if digits is not None else d for d in dots])


def _lit(v: np.ndarray) -> Column:
    return F.lit([float(x) for x in v]).cast("array<double>")


def moments(rows: DataFrame, z: str = "z") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and cross products of a vector column, by partition; blocks of equal shape are summed on the driver, one for each partition's group."""
    first = rows.select(F.size(z).alias("d")).first()
    d = first["d"] if first else 0

    def part(batches):
        import pandas as pd

        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["z"].to_numpy())
                n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        yield pd.DataFrame({"i": np.arange(d + 1), "v": [*g.tolist(), [*s.tolist(), float(n)][: d + 1]]})

    sums = rows.select(F.col(z).alias("z")).mapInPandas(part, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    g, s, n = np.zeros((d, d)), np.zeros(d), 0
    for r in sums:
        if r["i"] < d:
            g[r["i"], r["j"]] = r["x"]
        elif r["j"] < d:
            s[r["j"]] = r["x"]
        else:
            n = int(r["x"])
    return n, s, g


#: Dimensions whose cross products are summed up in full.
NARROW = 256


def fit_pca(rows: DataFrame, dim: int, z: str = "z", narrow: int = NARROW) -> Projection:
    """Standardise by population spread (+ 1e-9) and take the leading components; their largest loading is positive.

    Wider vectors than narrow go to wide.leading(), which makes no matrix of cross products.
    Null vectors take no part; no rows give no components.
    """
    rows = rows.where(F.col(z).isNotNull())
    first = rows.select(F.size(z).alias("d")).first()
    if first is None or first["d"] > narrow:
        return Projection(*leading(rows, dim, z))
    n, s, g = moments(rows, z)
    mean = s / max(n, 1)
    cov = g / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
    values, vectors = np.linalg.eigh(cov / np.outer(spread, spread))
    order = np.argsort(values)[::-1]
    rank = int((values > 1e-10).sum())
    k = max(1, min(dim, rank))
    comp = vectors[:, order[:k]].T
    comp *= np.sign(comp[np.arange(k), np.abs(comp).argmax(1)])[:, None]
    return Projection(mean, spread, comp, np.maximum(values[order[:k]], 0) / max(np.maximum(values, 0).sum(), 1e-300))


@dataclass
class Encoder:
    """A named representation: what vectors it takes, and how they were fitted."""

    name: str
    vectors: Callable[[DataFrame], DataFrame]
    projection: Projection | None = None

    def fit(self, rows: DataFrame, dim: int = 10) -> Encoder:
        return Encoder(self.name, self.vectors, fit_pca(self.vectors(rows), dim))

    def encode(self, rows: DataFrame) -> DataFrame:
        return self.vectors(rows).select("episode_id", self.projection.transform(F.col("z")).alias("z"))


def standardized(features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """M1: features by mean and population spread (+ 1e-9) of all rows."""
    m = features.agg(*[e for n in names for e in (F.avg(n).alias(f"{n}_m"), F.stddev_pop(n).alias(f"{n}_s"))])
    rows = features.crossJoin(F.broadcast(m))
    return rows.select("episode_id", *[((F.col(n) - F.col(f"{n}_m")) / (F.col(f"{n}_s") + 1e-9)).alias(n) for n in names])


def assign(rows: DataFrame, centres: DataFrame, z: str = "z") -> DataFrame:
    """M4: adds motif, the nearest of centres (motif, c), and d2; the lowest number of equally near ones.

    centres has k rows, which go to every task as one array; rows stay where they are.
    """
    every = centres.agg(F.collect_list(F.struct("motif", "c")).alias("_centres"))
    d2 = lambda c: F.aggregate(F.zip_with(F.col(z), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("_centres", lambda s: F.struct(d2(s["c"]).alias("d2"), s["motif"].alias("motif"))))
    near = rows.drop("motif", "d2").crossJoin(F.broadcast(every)).withColumn("_m", best)
    return near.withColumns({"motif": F.col("_m.motif"), "d2": F.col("_m.d2")}).drop("_m", "_centres")


def centroids(assigned: DataFrame, z: str = "z") -> DataFrame:
    """Mean vector of each motif."""
    long = assigned.select("motif", F.posexplode(z).alias("pos", "x")).groupBy("motif", "pos").agg(F.avg("x").alias("x"))
    return long.groupBy("motif").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)[None]).argmin(1)


def _in_one_task(vectors: DataFrame, centre: np.ndarray, iterations: int) -> tuple[np.ndarray, int]:
    """All iterations of kmeans() in the one task that holds the vectors."""
    width = centre.shape[1]

    def run(batches):
        import pyarrow as pa

        parts = [np.asarray(b.column("z").flatten()).reshape(len(b), -1) for b in batches if len(b)]
        x, now, rounds = np.concatenate(parts), centre, iterations
        for it in range(iterations):
            near, total = _nearest(x, now), np.zeros_like(now)
            np.add.at(total, near, x)
            count = np.bincount(near, minlength=len(now))
            new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], now)
            if np.array_equal(new, now):
                rounds = it + 1
                break
            now = new
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(now), dtype=np.int32)), pa.array(now.tolist(), pa.list_(pa.float64())), pa.array(np.full(len(now), rounds, np.int32))], ["motif", "c", "rounds"])

    got = sorted(vectors.mapInArrow(run, "motif int, c array<double>, rounds int").collect())
    return np.array([r["c"] for r in got]).reshape(-1, width), got[0]["rounds"]


def kmeans(rows: DataFrame, k: int, iterations: int = 100, seed: int = 0, z: str = "z", task_bytes: int = 32 << 20) -> tuple[np.ndarray, int]:
    """M4: Lloyd's centres from k distinct rows; an empty cluster keeps its centre; stops early at a fixed point.

    rows is read once an iteration, so it should be a written table, see settled(). There are as
    few tasks as hold task_bytes of vectors each, and a task gives one row of sums for each
    centre; where a single one holds all, it runs all iterations.
    """
    start = rows.select(z).distinct().orderBy(F.xxhash64(F.col(z), F.lit(seed)), z).limit(k).collect()
    centre = np.array([r[0] for r in start], np.float64)
    if not len(centre):
        return centre, 0
    sc, width = rows.sparkSession.sparkContext, centre.shape[1]
    tasks = max(1, -(-rows.count() * width * 8 // task_bytes))
    vectors = rows.select(F.col(z).alias("z")).coalesce(tasks)
    if tasks == 1:
        return _in_one_task(vectors, centre, iterations)
    for it in range(iterations):
        c = sc.broadcast(centre)

        def part(batches, c=c):
            import pyarrow as pa

            m = c.value
            total, count = np.zeros_like(m), np.zeros(len(m))
            for batch in batches:
                if len(batch):
                    x = np.asarray(batch.column("z").flatten()).reshape(len(batch), -1)
                    near = _nearest(x, m)
                    np.add.at(total, near, x)
                    count += np.bincount(near, minlength=len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(count)], ["motif", "s", "n"])

        sums = vectors.mapInArrow(part, "motif int, s array<double>, n double").groupBy("motif").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(width)])
        new = centre.copy()
        for r in sums.collect():
            if r["n"]:
                new[r["motif"]] = np.array([r[f"s{j}"] for j in range(width)]) / r["n"]
        c.unpersist()
        if np.array_equal(new, centre):
            return centre, it + 1
        centre = new
    return centre, iterations


def centre_table(spark, centre: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centre)], "motif int, c array<double>")


def occupancy(assigned: DataFrame, group: str = "label") -> DataFrame:
    """Share of each motif within each group, zeros included, shares of a group sum to 1."""
    groups, motifs = assigned.select(group).distinct(), assigned.select("motif").distinct()
    got = assigned.groupBy(group, "motif").agg(F.count("*").alias("n"))
    full = groups.crossJoin(F.broadcast(motifs)).join(got, [group, "motif"], "left").select(group, "motif", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group)))
