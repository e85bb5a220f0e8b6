"""All rows against all: what is shuffled is a fixed number of copies of the rows."""

import numpy as np
import pytest

from gaitspark.operators import retrieval as R

from .test_block_search import brute
from .test_cells import plan


def table(spark, z):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>")


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("most", [80_000, 25])
def test_a_row_goes_to_each_block_once(spark, monkeypatch, k, most):
    for name, value in (("QUERY_BLOCK", 40), ("ALL_ROWS", most)):
        monkeypatch.setattr(R, name, value, raising=False)
    z = np.random.default_rng(2).normal(size=(300, 40))
    z[200:210] = z[:10]
    got = R.all_knn(table(spark, z), k)
    assert {(r.query_id, r["rank"]): r.id for r in got.collect()} == brute(z, z, k, "euclidean")
    text = plan(got).split("Initial Plan")[-1]
    assert text.count("explode(") == 1


def test_copies_are_not_sent_to_all_pieces_of_their_ring(spark, monkeypatch):
    """They lie in one ring of many pieces, to each of which each of them went."""
    monkeypatch.setattr(R, "QUERY_BLOCK", 20)
    far = 1000 * np.random.default_rng(5).normal(size=(120, 3))
    z = np.concatenate([np.tile(far[:1], (480, 1)), far])
    got = R.all_knn(table(spark, z), 3)
    assert "turn" not in plan(got)
    assert {(r.query_id, r["rank"]): r.id for r in got.collect()} == brute(z, z, 3, "euclidean")


def test_few_blocks_are_visited_however_many_there_are(spark, monkeypatch):
    """A fifth of many blocks is many copies of a row."""
    monkeypatch.setattr(R, "QUERY_BLOCK", 10)
    z = np.random.default_rng(7).uniform(size=(800, 3))
    rows = R._usable(table(spark, z))
    assert R._visits(rows, 3, "euclidean", 80, 10, 0.9)[2] is None
    got = R.all_knn(table(spark, z), 3)
    assert {(r.query_id, r["rank"]): r.id for r in got.collect()} == brute(z, z, 3, "euclidean")
