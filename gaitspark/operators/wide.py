"""Leading components of wide vectors: a block of directions is turned towards them, a pass over the rows a turn.

No d x d matrix is ever made. A task holds one block of rows and the directions (d
times a few dozen numbers) and gives one row of d sums for each direction; sums of tasks are added up in two
levels, so no group has more rows than FAN or tasks / FAN.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that the tasks' sums are first added up in.
FAN = 64


def _added(key, table):
    import pyarrow as pa

    v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(0)
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})


def _sums(vectors: DataFrame, lines: int, width: int, step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of step(block of rows), a matrix of lines x width, over all blocks."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros((lines, width))
        for batch in batches:
            if len(batch):
                total += step(np.asarray(batch.column("z").flatten()).reshape(len(batch), -1))
        part = TaskContext.get().partitionId() % FAN
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lines, dtype=np.int32)), pa.array(np.full(lines, part, np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "part", "v"])

    got = vectors.mapInArrow(run, "i int, part int, v array<double>")
    got = got.groupBy("i", "part").applyInArrow(_added, "i int, v array<double>").groupBy("i").applyInArrow(_added, "i int, v array<double>")
    out = np.zeros((lines, width))
    for r in got.collect():
        out[r["i"]] = r["v"]
    return out


def leading(rows: DataFrame, dim: int, z: str = "z", extra: int = 12, rounds: int = 80, tolerance: float = 1e-9, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, population spread (+ 1e-9), components (at most dim, rows) and their shares of variance of the standardised vectors.

    Each round maps dim + extra directions by the correlation matrix and takes the best
    combinations; it ends when what is left of each component's image beside itself is under tolerance times the
    greatest variance. After so many rounds it warns and gives what it has: then components of nearly
    equal variance are not told apart. rows should be a written table. Null vectors take no part.
    """
    vectors = rows.select(F.col(z).cast("array<double>").alias("z")).where("z is not null")
    first = vectors.first()
    if first is None or not len(first["z"]):
        return np.zeros(0), np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    origin = np.array(first["z"])
    d = len(origin)
    moments = _sums(vectors, 3, d, lambda x: np.stack([(x - origin).sum(0), ((x - origin) ** 2).sum(0), np.full(d, float(len(x)))]))
    n = moments[2, 0]
    off = moments[0] / n
    mean, variance = origin + off, np.maximum(moments[1] / n - off**2, 0)
    spread = np.sqrt(variance) + 1e-9
    width = min(d, dim + extra)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    sc = rows.sparkSession.sparkContext
    for at in range(rounds):
        shared = sc.broadcast((mean, spread, q))

        def image(x, shared=shared):
            m, s, now = shared.value
            x = (x - m) / s
            return (x @ now).T @ x

        b = _sums(vectors, width, d, image).T / n
        shared.unpersist()
        inner = q.T @ b
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        best, beside = q @ turn, b @ turn - (q @ turn) * values
        k = max(1, min(dim, int((values > 1e-10).sum())))
        if np.linalg.norm(beside[:, :k], axis=0).max() <= tolerance * max(values[0], 1e-300) or width == d and at > 0:
            break
        q = np.linalg.qr(b)[0]
    else:
        warnings.warn(f"components are not settled after {rounds} rounds", stacklevel=2)
    comp = best[:, :k].T
    comp = comp * np.sign(comp[np.arange(k), np.abs(comp).argmax(1)])[:, None]
    return mean, spread, comp, np.maximum(values[:k], 0) / max((variance / spread**2).sum(), 1e-300)
