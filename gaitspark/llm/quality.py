"""Quality classifier: naive Bayes support vectors.

Indicators of byte n-grams are scaled by their class log-count ratios, then a
linear model with squared hinge loss is fitted by dual coordinate descent. A logistic
curve over margins of rows the model did not see turns a margin into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, worker_path

BITS = 18
#: Texts with fewer n-grams than this say less, and their margins stay nearer to the bias.
SHORT = 400


def ngrams(text: str | None, longest: int = 3) -> np.ndarray:
    """Distinct hashed byte n-grams of 1 to longest bytes (at most 3), of the whole text."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    codes, code = [], b + np.uint32(1)
    for n in range(1, min(longest, len(b)) + 1):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) ^ b[n - 1 :]
        codes.append((code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B % 2**32)) >> np.uint32(32 - BITS))
    return np.unique(np.concatenate(codes)).astype(np.int32) if codes else np.empty(0, np.int32)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Logarithm of the classes' smoothed, normalised indicator counts."""
    both = [alpha + np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k == c] or [np.empty(0, np.int32)]), minlength=1 << BITS) for c in (1, 0)]
    return np.log(both[0] / both[0].sum()) - np.log(both[1] / both[1].sum())


def hinge_dual(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 1) -> np.ndarray:
    """Dual coordinate descent for the squared hinge loss; the last weight is the bias."""
    w, alpha, rng = np.zeros((1 << BITS) + 1), np.zeros(len(rows)), np.random.Generator(np.random.PCG64(seed))
    diag = 0.5 / cost
    square = np.array([v @ v + 1.0 for v in values]) + diag
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1 + diag[i] * alpha[i]
            if abs(min(g, 0.0) if alpha[i] == 0 else g) < 1e-9:
                continue
            new = max(alpha[i] - g / square[i], 0.0)
            step = (new - alpha[i]) * y[i]
            worst, alpha[i] = max(worst, abs(g)), new
            w[rows[i]] += step * values[i]
            w[-1] += step
        if worst < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton's method with smoothed targets."""
    pos = max(int(y.sum()), 0)
    neg = len(y) - pos
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, beta = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * beta)
        beta -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


@dataclass
class NbSvm:
    """weights: by hashed n-gram, over the root of the number of n-grams of a text."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum() / np.sqrt(max(len(features), SHORT))) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ngrams(text)) + self.offset, -30, 30))))


def _train(rows: list[np.ndarray], y: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    ratio = log_count_ratios(rows, y)
    values = [(ratio[r] / np.sqrt(max(len(r), SHORT))).astype(np.float32) for r in rows]
    share = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    w = hinge_dual(rows, values, np.where(y == 1, 1.0, -1.0), cost * share)
    return ratio * w[:-1], float(w[-1])


def folded_margins(rows: list[np.ndarray], y: np.ndarray, cost: float, folds: int) -> np.ndarray:
    """The margin of each row (its n-grams) under a model that was not fitted on it; 0 where the others have one class only."""
    fold, margin = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        if not len(inside) or y[inside].min() == y[inside].max():
            continue
        w, b = _train([rows[i] for i in inside], y[inside], cost)
        part = NbSvm(w, b, 1, 0)
        for i in np.flatnonzero(fold == k):
            margin[i] = part.margin(rows[i])
    return margin


def fit(texts: list[str | None], labels: list[int], cost: float = 1.0, folds: int = 4) -> NbSvm:
    """Fit on texts in memory. Without rows of both classes the score is the share of label 1 (0.5 without rows)."""
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return NbSvm(np.zeros(1 << BITS, np.float32), 0.0, 1e-3, float(np.log(p / (1 - p))))
    rows = [ngrams(t) for t in texts]
    slope, offset = logistic(folded_margins(rows, y, cost, folds), y)
    w, b = _train(rows, y, cost)
    return NbSvm(w.astype(np.float32), b, slope, offset)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = 64 << 20) -> tuple[list[str], list[int]]:
    """At most ``most`` labelled texts of at most most_bytes together: those whose ids hash lowest.

    Rows without id, label or text are left out; of several texts of an id the first
    counts. A text that does not fit into the rest of most_bytes is passed over.
    """
    picked = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).where("doc_id is not null and text is not null")
    got = materialize(known.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "labelled")
    sizes = got.select("doc_id", F.octet_length("text").alias("n")).collect()
    fits, held = [], 0
    for r in sorted(sizes, key=lambda r: (hash_order(r["doc_id"]), r["doc_id"])):
        if held + r["n"] <= most_bytes:
            fits.append((r["doc_id"],))
            held += r["n"]
    if len(fits) < len(sizes):
        got = got.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "doc_id long")), "doc_id")
    rows = sorted(got.collect(), key=lambda r: (hash_order(r["doc_id"]), r["doc_id"]))
    return [r["text"] for r in rows], [int(r["label"] > 0) for r in rows]


def hash_order(n: int) -> int:
    """Mixes ids, so that folds do not follow their order."""
    n = (n ^ (n >> 31)) * 0x9E3779B97F4A7C15 % 2**64
    return n ^ (n >> 29)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 6000, cost: float = 1.0) -> NbSvm:
    """Fit to labels.quality on a sample of at most ``most`` labelled rows, the parameter that bounds the driver's memory."""
    return fit(*training_rows(docs, labels, "quality", most), cost=cost)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            names = [n for n in batch.schema.names if n != "score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([m.score(t) for t in batch.column("text").to_pylist()], pa.float64())], [*names, "score"])

    return run


def score_quality(docs: DataFrame, model: NbSvm) -> DataFrame:
    """docs with score, the probability of label 1 (a column of that name is replaced).

    Every row is scored on its whole text; null and empty texts get the bias's score.
    """
    worker_path(docs.sparkSession)
    docs = docs.drop("score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"{kinds}, score double")
