"""Tiles of products in single precision: the nearest by plain differences in double precision, found from few candidates."""

import numpy as np
import pytest

from gaitspark.operators import retrieval as R

rng = np.random.default_rng(6)
Z = rng.normal(size=(400, 8))
CASES = {
    "spread": Z, "copies": np.concatenate([np.tile(Z[:1], (250, 1)), Z[:150]]), "far": Z + 1e6, "outlier": np.where(np.arange(400)[:, None] == 5, 1e12 * Z, Z), "tiny": Z * 1e-200, "large": Z * 1e140,
    "whole numbers": rng.integers(-1, 2, (400, 3)).astype(float), "close": Z[:1] + 1e-9 * Z, "zeros": np.zeros((60, 3)), "few": Z[:4],
}


def plainly(k, x, ids, q, qid, own):
    out = []
    for z, who in zip(q, qid, strict=True):
        d = np.sqrt(((x - z) ** 2).sum(1))
        near = [j for j in np.lexsort((ids, d)) if ids[j] != who or not own][:k]
        out += [(who, ids[j], d[j]) for j in near]
    return out


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("own", [True, False])
def test_best_is_that_of_plain_differences(monkeypatch, name, own):
    for limit, value in (("ASKED", 7), ("SOME", 64), ("PAIRS", 500)):
        monkeypatch.setattr(R, limit, value)
    x = CASES[name]
    ids = np.random.default_rng(1).permutation(len(x)) // (2 if name == "spread" else 1)
    for k in (1, 6, 100):
        got = R._best(k, x, ids, x[::9], ids[::9], "euclidean", own)
        assert list(got.itertuples(index=False, name=None)) == plainly(k, x, ids, x[::9], ids[::9], own)


@pytest.mark.parametrize("name, most", [("spread", 20), ("far", 20), ("outlier", 20), ("close", 20), ("copies", 25)])
def test_few_rows_are_measured_exactly(name, most):
    """Neither a common offset, nor one row far out, nor copies let many rows pass."""
    x, ids = R._few_copies(CASES[name], np.arange(400), 9)
    left, right, spare = R._bounding(x, CASES[name][::9])
    i, j = R._candidates(9, left, right, *spare)
    assert (np.bincount(i) >= 9).all() and len(i) <= most * len(left)


def test_many_blocks_need_no_more_pieces():
    """What is shuffled is rows times blocks and pieces: at six times the rows it is little more than six times as much."""
    assert R._grid(12_308, 615_384) == (1, 16) and R._grid(102_564, 102_564) == (2, 16)
    blocks, pieces = R._grid(615_384, 615_384)
    assert blocks * pieces > 50 and 615_384 * (blocks + pieces) <= 6.7 * 102_564 * (2 + 16)
