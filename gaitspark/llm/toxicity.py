"""Toxicity as ordinal severity: a cumulative-link model over sparse text features.

Features are the distinct words of a text and the beginnings of its words, so that
inflected forms share evidence. One weight for each feature serves all ordered
thresholds: P(grade > k) = logistic(x.w - threshold k). The result is the expected
grade, the sum of these probabilities.

Where labels are 0 and 1 only, toxic rows are graded by a second, unlike view: their
margins under a model of byte n-grams that was not fitted on them. The first
threshold carries the label itself, the second one the strength of that evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import worker_path
from .quality import folded_margins, ngrams, training_rows

WORD = re.compile(r"\w+")
STARTS = (4, 5, 6)


def features(text: str | None) -> set[str]:
    """Distinct lower-case words, and their beginnings of 4 to 6 characters with a mark behind."""
    words = set(WORD.findall((text or "").lower()))
    out = set(words)
    for n in STARTS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


class Signs(dict):
    """The model's features that a word brings, kept for the words seen lately."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...] | None:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = tuple(f for f in (word, *(word[:n] + "*" for n in STARTS if len(word) > n)) if f in self.weights) or None
        return got


@dataclass
class CumulativeLink:
    """weights by feature; thresholds ascend, one fewer than there are grades."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [30.0])

    def above(self, text: str | None, signs: Signs | None = None) -> np.ndarray:
        """P(grade > k) for each threshold."""
        signs = Signs(self.weights) if signs is None else signs
        found = set().union(*filter(None, map(signs.__getitem__, set(WORD.findall((text or "").lower())))))
        z = sum(self.weights[f] for f in found)
        return 1 / (1 + np.exp(-np.clip(z - np.array(self.thresholds), -30, 30)))


def severity_grades(texts: list[str | None], toxic: np.ndarray, folds: int = 4) -> np.ndarray:
    """Grades from binary labels: 0 for clean rows, 1 for toxic ones, 2 for those whose margin, by a byte n-gram model of the other folds, is over the toxic rows' median."""
    if not toxic.any():
        return np.zeros(len(toxic), np.int64)
    margin = folded_margins([ngrams(t) for t in texts], toxic, 1.0, folds)
    return np.where(toxic == 1, 1 + (margin > np.median(margin[toxic == 1])), 0)


def candidates(texts: list[str | None], toxic: np.ndarray, most: int = 1500, least: int = 3) -> list[str]:
    """Features whose share among toxic rows is at least four times that among clean rows, by significance.

    Signs of clean texts are left out: they stand for topics, and a toxic remark in a
    text on such a topic is no milder (with them, fewer held-out toxic rows rank over clean ones).
    Only features of enough toxic rows are counted among the others, so the counts stay small.
    """
    bad: Counter[str] = Counter()
    for t, y in zip(texts, toxic, strict=True):
        if y:
            bad.update(features(t))
    bad = Counter({f: a for f, a in bad.items() if a >= least})
    clean: Counter[str] = Counter()
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            clean.update(f for f in features(t) if f in bad)
    n1, n0 = max(int(toxic.sum()), 1), max(len(texts) - int(toxic.sum()), 1)
    scored = []
    for f, a in bad.items():
        p, q = (a + 0.1) / n1, (clean[f] + 0.5) / n0
        if p >= 4 * q:
            scored.append((-a * np.log(p / q), f))
    return [f for _, f in sorted(scored)[:most]]


def fit_cumulative(x: np.ndarray, grade: np.ndarray, levels: int, ridge: float = 0.02, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds, by gradient steps with momentum and adaptive rates on the proportional-odds likelihood."""
    n, d = x.shape
    share = np.array([(grade > k).mean() for k in range(levels)]).clip(1e-3, 1 - 1e-3)
    cut = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(d), cut[:1], np.log(np.maximum(np.diff(cut), 0.05))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rows, turned = np.arange(n), np.ascontiguousarray(x.T)
    for t in range(1, steps + 1):
        gaps = np.exp(theta[d + 1 :])
        cuts = np.concatenate([[theta[d]], theta[d] + np.cumsum(gaps)])
        z = (x @ theta[:d].astype(np.float32)).astype(np.float64)
        s = np.ones((n, levels + 2))  # P(grade > k - 1)
        s[:, 1:-1] = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None], -30, 30)))
        s[:, -1] = 0
        p = np.maximum(s[rows, grade] - s[rows, grade + 1], 1e-9)
        slope = s * (1 - s)
        dz = (slope[rows, grade] - slope[rows, grade + 1]) / p
        dcut = np.zeros(levels)
        for k in range(levels):
            dcut[k] = (slope[grade == k, k + 1] / p[grade == k]).sum() - (slope[grade == k + 1, k + 1] / p[grade == k + 1]).sum()
        g = np.concatenate([-(turned @ dz.astype(np.float32)) + ridge * theta[:d], [-dcut.sum()], [-dcut[k + 1 :].sum() * gaps[k] for k in range(levels - 1)]]) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    gaps = np.exp(theta[d + 1 :])
    return theta[:d], np.concatenate([[theta[d]], theta[d] + np.cumsum(gaps)])


def fit(texts: list[str | None], toxic: list[int], grades: list[int] | None = None) -> CumulativeLink:
    """Fit on texts in memory. Without rows of both kinds no text is toxic."""
    y = (np.array(toxic, np.int64) > 0).astype(np.int64)
    if len(y) == 0 or y.min() == y.max():
        return CumulativeLink()
    names = candidates(texts, y)
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(texts), len(names)), np.float32)
    for i, t in enumerate(texts):
        x[i, [at[f] for f in features(t) if f in at]] = 1
    grade = np.array(grades, np.int64) if grades is not None else severity_grades(texts, y)
    levels = int(grade.max())
    w, cuts = fit_cumulative(x, grade, levels)
    return CumulativeLink({f: float(v) for f, v in zip(names, w, strict=True)}, [float(c) for c in cuts])


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 6000) -> CumulativeLink:
    """Fit to labels.toxic on a sample of at most ``most`` labelled rows, the parameter that bounds the driver's memory."""
    return fit(*training_rows(docs, labels, "toxic", most))


def _score(model, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        signs = Signs(m.weights)
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("severity", "toxic_probability", "toxic")]
            above = [m.above(t, signs) for t in batch.column("text").to_pylist()]
            first = [float(a[0]) for a in above]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([float(a.sum()) for a in above], pa.float64()), pa.array(first, pa.float64()), pa.array([p >= cut for p in first], pa.bool_())], [*names, "severity", "toxic_probability", "toxic"])

    return run


def score_toxicity(docs: DataFrame, model: CumulativeLink, cut: float = 0.5) -> DataFrame:
    """docs with severity (expected grade), toxic_probability (of a grade over 0) and toxic (that is cut or more).

    Columns of these names are replaced. Every row is scored on its whole text; null
    and empty texts get the thresholds' probabilities alone.
    """
    worker_path(docs.sparkSession)
    docs = docs.drop("severity", "toxic_probability", "toxic")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), cut), f"{kinds}, severity double, toxic_probability double, toxic boolean")
