"""Codes for vectors: each part of a vector is replaced by its nearest codebook entry, found by annular norm pruning.

All arithmetic is on integers, so results don't depend on the order of rows or
tasks. A round is one pass: each task assigns its vectors and sends at most one row
of sums for each entry; vectors are never shuffled. To find the nearest entry,
entries are sorted by norm. Since |norm(x) - norm(e)| <= distance(x, e), only entries
whose norm is within the best distance found so far can be nearer, or as near: a
binary search gives that annulus, which shrinks as entries are measured.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join, worker_path

SCALE = 1024
#: Vectors of neighbouring norms that are measured together, and entries measured at a time.
BLOCK, STEP = 128, 32
LONG = 2**63 - 1


def _whole(x: float) -> int:
    """floor(SCALE * x), also where the product is beyond a double."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(SCALE * x))


def quantized(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value) as integers: 64-bit ones where they are small, else Python's."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() < 2.0**40:
        return np.floor(SCALE * values).astype(np.int64)
    return np.array([_whole(x) for x in values.ravel().tolist()], object).reshape(values.shape)


def _small(*arrays: np.ndarray) -> bool:
    """Whether squared distances of these rows are exact in doubles."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return 4 * max(a.shape[1] for a in arrays) * most * most < 2**53


class Codebook:
    """Entries sorted by norm, for nearest()."""

    def __init__(self, entries: np.ndarray):
        squares = (entries.astype(object) ** 2).sum(1) if entries.size else np.zeros(len(entries), object)
        norms = np.array([float(s) ** 0.5 for s in squares])
        self.order = np.argsort(norms, kind="stable")
        self.entries, self.norms = entries[self.order], norms[self.order]

    def _measure(self, x: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Least squared distance of each x to entries a to b (sorted), and the lowest index that has it."""
        e, index = self.entries[a:b], self.order[a:b]
        d = (x * x).sum(1)[:, None] - 2 * (x @ e.T) + (e * e).sum(1)[None, :]
        least = d.min(1)
        return least, np.where(d == least[:, None], index[None, :], len(self.order)).min(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of x: index of the nearest entry (the lowest, if several), squared distance; and how many distances were measured."""
        kind = np.float64 if _small(x, self.entries) else object
        x = x.astype(kind)
        if self.entries.dtype != kind:
            self.entries = self.entries.astype(kind)
        norms = np.sqrt((x * x).sum(1).astype(np.float64))
        index, dist, measured = np.zeros(len(x), np.int64), np.zeros(len(x), kind), 0
        by_norm = np.argsort(norms, kind="stable")
        for at in range(0, len(x), BLOCK):
            rows = by_norm[at : at + BLOCK]
            v, r = x[rows], norms[rows]
            middle = int(np.searchsorted(self.norms, r[len(r) // 2]))
            a, b = max(0, middle - STEP // 2), min(len(self.norms), middle + STEP // 2)
            best, which = self._measure(v, a, b)
            measured += len(v) * (b - a)
            while True:
                # A little wider than the exact bound, for the norms are rounded; its ends belong to it.
                reach = np.sqrt(best.astype(np.float64)) + (r + 1) * 1e-9
                low = int(np.searchsorted(self.norms, (r - reach) * (1 - 1e-12), "left").min())
                high = int(np.searchsorted(self.norms, (r + reach) * (1 + 1e-12), "right").max())
                if low < a and (high <= b or a - low >= high - b):
                    span = (max(low, a - STEP), a)
                elif high > b:
                    span = (b, min(high, b + STEP))
                else:
                    break
                a, b = min(a, span[0]), max(b, span[1])
                d, i = self._measure(v, *span)
                measured += len(v) * (span[1] - span[0])
                better = (d < best) | ((d == best) & (i < which))
                best, which = np.where(better, d, best), np.where(better, i, which)
            index[rows], dist[rows] = which, best
        return index, dist, measured


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vector")
    return quantized(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.zeros((0, 0), np.int64)


def _parts(vectors: np.ndarray, parts: int) -> Iterator[np.ndarray]:
    width = vectors.shape[1] // parts
    return (vectors[:, p * width : (p + 1) * width] for p in range(parts))


def _sums(books: list[np.ndarray]):
    """A task's count and sums of each entry's parts: one row for each part and entry that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total = [Codebook(b) for b in books], {}
        for batch in batches:
            for p, part in enumerate(_parts(_vectors(batch), len(books))):
                if not len(part):
                    continue
                index = search[p].nearest(part)[0]
                order = np.argsort(index, kind="stable")
                entries, starts, counts = np.unique(index[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(part[order], starts, axis=0)
                for e, n, s in zip(entries.tolist(), counts.tolist(), sums.tolist(), strict=True):
                    n0, s0 = total.get((p, e), (0, [0] * len(s)))
                    total[p, e] = n0 + n, [a + b for a, b in zip(s0, s, strict=True)]
        yield _sum_rows(total)

    return run


def _sum_rows(total: dict) -> pa.RecordBatch:
    keys = list(total)
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array([p for p, _ in keys], pa.int32()),
            "entry": pa.array([e for _, e in keys], pa.int32()),
            "n": pa.array([total[k][0] for k in keys], pa.int64()),
            # As text, for sums of large components are beyond a long.
            "sums": pa.array([[str(x) for x in total[k][1]] for k in keys], pa.list_(pa.string())),
        }
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by part and entry, added up."""
    now, n, sums = None, 0, []
    for batch in batches:
        for p, e, count, texts in zip(*(batch.column(c).to_pylist() for c in ("part", "entry", "n", "sums")), strict=True):
            if (p, e) != now:
                if now:
                    yield _sum_rows({now: (n, sums)})
                now, n, sums = (p, e), 0, [0] * len(texts)
            n, sums = n + count, [a + int(b) for a, b in zip(sums, texts, strict=True)]
    if now:
        yield _sum_rows({now: (n, sums)})


def _encode(books: list[np.ndarray], names: list[str]):
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}")) if books else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for batch in batches:
            vectors = _vectors(batch)
            found = [s.nearest(part)[:2] if len(part) else ([], []) for s, part in zip(search, _parts(vectors, len(books)), strict=True)]
            codes = ["".join(f"{i:0{digits}x}" for i in row) for row in zip(*(np.asarray(i).tolist() for i, _ in found), strict=True)]
            errors = [min(int(sum(map(int, row))), LONG) for row in zip(*(np.asarray(d).tolist() for _, d in found), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], [*names, "code", "error"])

    return run


def _as_array(entries: list[list[int]], width: int) -> np.ndarray:
    big = any(abs(x) > 2**52 for row in entries for x in row)
    return np.array(entries, object if big else np.int64).reshape(len(entries), width)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """rows whose vector holds finite numbers only; null vectors, null and non-finite components leave."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))


def fit_codebooks(rows: DataFrame, key: str, vector: str, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """One integer codebook for each part position; see compress() for the rules. Empty without usable rows."""
    kept = usable(rows, vector)
    start = kept.orderBy(F.col(key).asc_nulls_last(), vector).select(vector).limit(entries).collect()
    if not start:
        return []
    width = len(start[0][0])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    kept = kept.where(F.size(vector) == width).select(F.col(vector).cast("array<double>").alias("vector"))
    first = quantized(np.array([r[0] for r in start if len(r[0]) == width], np.float64).reshape(-1, width))
    books = [_as_array(p.tolist(), width // parts) for p in _parts(first, parts)]
    kinds = "part int, entry int, n long, sums array<string>"
    for _ in range(rounds):
        sums = kept.mapInArrow(_sums(books), kinds).repartition("part", "entry").sortWithinPartitions("part", "entry").mapInArrow(_merged, kinds)
        new = [b.tolist() for b in books]
        for r in sums.collect():  # parts x entries rows at most
            new[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        books = [_as_array(b, width // parts) for b in new]
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], vector: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of rows with code (an entry's index for each part, two hex digits each or more) and error."""
    worker_path(rows.sparkSession)
    width = sum(b.shape[1] for b in books)
    plain = usable(rows, vector).where(F.size(vector) == width if books else F.lit(False))
    names = [f"_{i}" for i in range(len(keep))]
    plain = plain.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(vector).cast("array<double>").alias("vector"))
    kinds = ", ".join(f"{n} {plain.schema[n].dataType.simpleString()}" for n in names)
    out = plain.mapInArrow(_encode(books, names), f"{kinds}, code string, error long")
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "code", "error")


def decode(codes: DataFrame, books: list[np.ndarray], code: str = "code") -> DataFrame:
    """codes with vector (array<double>): the entries that the code names, in the units of the vectors."""
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))
    tables = [F.array(*[F.array(*[F.lit(x / SCALE) for x in row]) for row in b.tolist()]) for b in books]
    index = [F.conv(F.substring(code, p * digits + 1, digits), 16, 10).cast("int") for p in range(len(books))]
    return codes.withColumn("vector", F.concat(*[F.get(t, i) for t, i in zip(tables, index, strict=True)]))


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """(key, label, code, error, label_error) of every usable row, and the codebooks.

    Rows whose vector is null or holds null or non-finite components leave, and so do
    vectors of another length than that of the smallest key. Components become
    floor(1024 * x). A codebook starts as the parts of the ``entries`` smallest keys
    (null keys last, equal keys by vector; repeated rows are an entry each); a round
    assigns every part to its nearest entry (squared Euclidean distance, ties to the
    lower index), then replaces each entry by the floor of its parts' mean; unused ones
    stay. label_error is the error summed over equal labels, nulls together. An error
    beyond a long is given as the largest long. No usable rows give no rows. Other
    columns are left alone. rows is read once a round, so an expensive plan should be
    written first. ValueError if a vector can't be cut into equal parts.
    """
    worker_path(rows.sparkSession)
    books = fit_codebooks(rows, key, vector, parts, entries, rounds)
    coded = materialize(encode(rows, books, vector, [key, label]).withColumn("_label", F.to_json(F.struct(F.col(label).alias("l")))), "codes")
    sums = coded.groupBy("_label").agg(F.coalesce(F.try_sum("error"), F.lit(LONG)).alias("label_error"), F.count("*").alias("_n"))
    # A few labels hold most rows: those are sent to the rows.
    out = spread_join(coded, sums, "_label", "_n", coded.count())
    return out.select(key, label, "code", "error", "label_error"), books
