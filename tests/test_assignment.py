"""Assignment and gap filling against the plain loops they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from gaitspark.operators import assignment as AS
from gaitspark.operators import tracking as T

from .test_segments import DETS, crowd

PAIRS = "g int, l int, r int, cost double"


def greedy(rows):
    used, out = set(), []
    for g, a, b, c in sorted((x for x in rows if None not in x), key=lambda x: (x[0], x[3], x[1], x[2])):
        if (g, 0, a) not in used and (g, 1, b) not in used:
            used |= {(g, 0, a), (g, 1, b)}
            out.append((g, a, b, c))
    return sorted(out)


@pytest.mark.parametrize("seed, ties", [(1, False), (2, True)])
def test_rounds_are_the_sorted_greedy_order(spark, seed, ties):
    r = random.Random(seed)
    rows = [(g, a, b, float(r.randint(0, 3)) if ties else r.random()) for g in range(5) for a in range(12) for b in range(12) if r.random() < 0.5]
    rows += [(0, 1, 2, 0.5), (0, 1, 2, 0.25), (0, None, 2, 0.0), (0, 1, None, 0.0), (9, 1, 1, None)]
    got = AS.greedy_assignment(spark.createDataFrame(rows, PAIRS).repartition(3), ["g", "l"], ["g", "r"])
    assert sorted(tuple(x) for x in got.collect()) == greedy(rows)


def test_a_chain_and_a_hub(spark):
    """Each pair waits for the one before it; a node with very many pairs takes one."""
    chain = [(0, i, i, 2.0 * i) for i in range(6)] + [(0, i + 1, i, 2.0 * i + 1) for i in range(6)]
    hub = [(1, 0, i, float(i % 7)) for i in range(3000)]
    got = AS.greedy_assignment(spark.createDataFrame(chain + hub, PAIRS), ["g", "l"], ["g", "r"])
    assert sorted(tuple(x) for x in got.collect()) == greedy(chain + hub)
    assert AS.greedy_assignment(spark.createDataFrame([], PAIRS), ["g", "l"], ["g", "r"]).count() == 0


def test_gaps_are_filled_as_the_tracker_does(spark):
    points = T.track(spark.createDataFrame(crowd(8, ["a", "b"], 150), DETS)).cache()
    got = AS.fill_gaps(points.where("state = 'observed'"))
    cols = ["video_id", "track", "frame", "x", "y", "w", "h", "confidence", "association", "state"]
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())
    assert points.where("state = 'interpolated'").count() > 20 and key(got) == key(points)


def test_gap_bounds(spark):
    rows = [("v", 1, f, float(f), 0.0, 1.0, 1.0, 1.0, 0.8, "observed") for f in (0, 2, 6, 11)] + [("v", 2, 3, 0.0, 0.0, 1.0, 1.0, 1.0, 0.8, "observed")]
    got = AS.fill_gaps(spark.createDataFrame(rows, "video_id string, track long, frame long, x double, y double, w double, h double, confidence double, association double, state string"))
    assert [r.frame for r in got.where("state = 'interpolated'").orderBy("frame").collect()] == [1, 3, 4, 5]


def test_costs_within_the_gate(spark):
    tracks = spark.createDataFrame([("v", 5, 1, 4, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0), ("v", 5, 2, 2, 200.0, 10.0, 195.0, 5.0, 205.0, 15.0)], "video_id string, frame long, track long, last_frame long, x double, y double, x1 double, y1 double, x2 double, y2 double")
    dets = spark.createDataFrame([("v", 5, 7, 5.0, 5.0, 15.0, 15.0), ("v", 5, 8, 65.0, 5.0, 75.0, 15.0), ("v", 6, 9, 5.0, 5.0, 15.0, 15.0)], "video_id string, frame long, detection long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.track, r.detection): r.cost for r in AS.gated_costs(tracks, dets).collect()}
    assert got == {(1, 7): 0.0, (1, 8): 60.0, (2, 8): 130.0}
    assert AS.gated_costs(tracks, dets.withColumn("extra", F.lit(1))).columns == ["video_id", "frame", "track", "detection", "cost"]


def test_upper_median_of_lengths(spark):
    rows = [("v", t, f) for t, n in enumerate([1, 4, 4, 9]) for f in range(n)] + [("w", t, f) for t, n in enumerate([5, 1, 2]) for f in range(n)] + [("x", 0, 0)]
    got = {r.video_id: (r.tracks, r.median_length) for r in T.run_stats(spark.createDataFrame(rows, "video_id string, track long, frame long")).collect()}
    assert got == {"v": (4, 4), "w": (3, 2), "x": (1, 1)}
