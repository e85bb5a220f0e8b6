"""Cluster bootstrap of any statistic that merges, with all replicates in one pass over the rows.

A replicate draws as many clusters as there are, with replacement, so each cluster has
a weight and the weights of a replicate are multinomial. Clusters lie in blocks of bounded size;
a replicate's draws are first split over the blocks, then within each, so the task
that holds rows of a block makes the block's weights itself, from seed, replicate
and block alone. A statistic is told values with a weight for each replicate and
keeps a state; states merge in two stages. No group holds a replicate, no row is
multiplied, and a cluster of any size is dealt over tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ranked, settled, share_package

#: Clusters of a block at most, about; rows of a block that one task takes, about.
CLUSTERS, ROWS = 10_000, 1_000_000


class Statistic:
    """A statistic of weighted rows, for many replicates at once.

    columns are the numbers it reads; rows with a null in one leave. A state is
    any object that pickles; weights are (rows, replicates).
    """

    columns: tuple[str, ...] = ()

    def init(self, replicates: int):
        raise NotImplementedError

    def update(self, state, values: list[np.ndarray], weights: np.ndarray):
        raise NotImplementedError

    def merge(self, a, b):
        return a + b

    def finish(self, state) -> np.ndarray:
        """One value for each replicate; NaN where there is none."""
        raise NotImplementedError


class Mean(Statistic):
    def __init__(self, value: str):
        self.columns = (value,)

    def init(self, replicates: int) -> np.ndarray:
        return np.zeros((2, replicates))

    def update(self, state, values, weights):
        return state + np.stack([values[0] @ weights, weights.sum(0)])

    def finish(self, state):
        with np.errstate(invalid="ignore", divide="ignore"):
            return state[0] / state[1]


class Correlation(Statistic):
    """Pearson's correlation; ``at`` is a value near the columns' middle, so that sums of squares keep their digits."""

    def __init__(self, x: str, y: str, at: tuple[float, float] = (0.0, 0.0)):
        self.columns, self.at = (x, y), at

    def init(self, replicates: int) -> np.ndarray:
        return np.zeros((6, replicates))

    def update(self, state, values, weights):
        x, y = values[0] - self.at[0], values[1] - self.at[1]
        return state + np.stack([np.ones_like(x), x, y, x * x, y * y, x * y]) @ weights

    def finish(self, state):
        n, x, y, xx, yy, xy = state
        with np.errstate(invalid="ignore", divide="ignore"):
            return (n * xy - x * y) / np.sqrt((n * xx - x * x) * (n * yy - y * y))


class Quantile(Statistic):
    """A quantile within ``error`` of its value: weights by buckets whose bounds grow by a constant factor, for either sign.

    The lower one of two middle values. A state holds the buckets met, so it is bounded by
    the span of the values' magnitudes: about 1,150 buckets for 10 powers of ten at 1 %.
    """

    def __init__(self, value: str, q: float, error: float = 0.01):
        self.columns, self.q, self.log = (value,), q, np.log((1 + error) / (1 - error))

    def init(self, replicates: int) -> dict[int, np.ndarray]:
        return {}

    def _bucket(self, x: np.ndarray) -> np.ndarray:
        """Numbers that rise with the values: 0 for 0, shifted powers on either side."""
        with np.errstate(divide="ignore", invalid="ignore"):
            power = np.ceil(np.log(np.abs(x)) / self.log)
            return np.where(x == 0, 0, np.sign(x) * (power + 1e6)).astype(np.int64)

    def update(self, state, values, weights):
        buckets, which = np.unique(self._bucket(values[0]), return_inverse=True)
        order = np.argsort(which, kind="stable")
        sums = np.add.reduceat(weights[order], np.searchsorted(which[order], np.arange(len(buckets))), axis=0)
        return self.merge(state, dict(zip(buckets.tolist(), sums, strict=True)))

    def merge(self, a, b):
        for k, w in b.items():
            a[k] = a[k] + w if k in a else w
        return a

    def finish(self, state):
        keys = sorted(state)
        if not keys:
            return np.array([])
        total = np.cumsum([state[k] for k in keys], axis=0)
        at = (total < np.ceil(np.maximum(self.q * total[-1], 1))).sum(0)
        middle = [0.0 if k == 0 else np.sign(k) * 2 * np.exp((abs(k) - 1_000_000) * self.log) / (np.exp(self.log) + 1) for k in keys]
        return np.where(total[-1] > 0, np.array(middle)[np.minimum(at, len(keys) - 1)], np.nan)


def block_weights(sizes: np.ndarray, block: int, replicates: int, seed: int) -> np.ndarray:
    """(clusters of the block, replicates + 1): how often each replicate draws each cluster; the first column is 1 for all, the estimate's."""
    k, p = int(sizes.sum()), sizes / max(sizes.sum(), 1)
    out = np.ones((int(sizes[block]), replicates + 1))
    for r in range(replicates):
        own = np.random.default_rng([seed, r]).multinomial(k, p)[block]
        out[:, r + 1] = np.random.default_rng([seed, r, block]).multinomial(own, np.full(len(out), 1 / len(out)))
    return out


def _partial(stats: dict[str, Statistic], columns: list[str], sizes: np.ndarray, replicates: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, now, weights = {n: s.init(replicates + 1) for n, s in stats.items()}, None, None
        for batch in batches:
            values = {c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float) for c in columns}
            blocks, places = batch.column("_block").to_numpy(), batch.column("_place").to_numpy()
            for block in np.unique(blocks).tolist():
                if block != now:
                    now, weights = block, block_weights(sizes, block, replicates, seed)
                for at in np.array_split(np.flatnonzero(blocks == block), len(blocks) // 2_000 + 1):
                    for name, s in stats.items():
                        read = [values[c][at] for c in s.columns]
                        ok = ~np.any([np.isnan(v) for v in read], axis=0)
                        if ok.any():
                            states[name] = s.update(states[name], [v[ok] for v in read], weights[places[at][ok]])
        yield _state_row(states)

    return run


def _state_row(states: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(states)], pa.binary())], ["states"])


def _merge(stats: dict[str, Statistic]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for raw in batch.column("states").to_pylist():
                new = pickle.loads(raw)
                held = new if held is None else {n: s.merge(held[n], new[n]) for n, s in stats.items()}
        if held is not None:
            yield _state_row(held)

    return run


def bootstrap(episodes: DataFrame, stats: dict[str, Statistic], cluster: str, replicates: int = 500, seed: int = 0) -> DataFrame:
    """(statistic, estimate, lo, hi, clusters, replicates): each statistic over all rows, and the middle 95 % of its values over replicates that draw whole clusters.

    Rows with a null cluster leave, and for a statistic rows with a null or NaN in its columns. Replicates
    for which a statistic has no value do not count; without rows all is null. What
    reaches the driver is a count for each block of clusters and one merged state.
    """
    spark = episodes.sparkSession
    share_package(spark)
    columns = sorted({c for s in stats.values() for c in s.columns})
    rows = episodes.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("_cluster"), *[F.col(c).cast("double").alias(c) for c in columns], F.monotonically_increasing_id().alias("_row"))
    keys = ranked(rows.groupBy("_cluster").agg(F.count("*").alias("_n")), "_cluster")
    keys = settled(keys.select("_cluster", "_n", F.floor(F.col("no") / CLUSTERS).alias("_block"), (F.col("no") % CLUSTERS).alias("_place")), "clusters")
    blocks = keys.groupBy("_block").agg(F.count("*").alias("size"), F.ceil(F.sum("_n") / ROWS).alias("_salts")).orderBy("_block").collect()
    sizes = np.array([b["size"] for b in blocks], np.int64)
    salts = F.broadcast(spark.createDataFrame([(b["_block"], b["_salts"]) for b in blocks], "_block long, _salts long"))
    placed = rows.join(keys.drop("_n"), "_cluster").join(salts, "_block").withColumn("_salt", F.pmod("_row", "_salts"))
    dealt = placed.select("_block", "_salt", "_place", *columns).repartition("_block", "_salt").sortWithinPartitions("_block")
    states = settled(dealt.mapInArrow(_partial(stats, columns, sizes, replicates, seed), "states binary"), "states")
    some = max(1, int(states.count() ** 0.5))
    merged = states.repartition(some).mapInArrow(_merge(stats), "states binary").repartition(1).mapInArrow(_merge(stats), "states binary").collect()
    final = pickle.loads(merged[0]["states"]) if merged and blocks else {}
    out = []
    for name, s in stats.items():
        got = np.asarray(s.finish(final[name]), float) if final else np.array([])
        drawn = got[1:][~np.isnan(got[1:])]
        lo, hi = np.quantile(drawn, [0.025, 0.975]).tolist() if len(drawn) else (None, None)
        out.append((name, float(got[0]) if len(got) and not np.isnan(got[0]) else None, lo, hi, int(sizes.sum()), replicates))
    return spark.createDataFrame(out, "statistic string, estimate double, lo double, hi double, clusters long, replicates int")
