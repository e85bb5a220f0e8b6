import datetime

import pytest

from gaitspark.plans import adapters, catalog

#: (second, user, value, k): three events of user 10 in the first hour, one an hour later; user 20 beside it.
EVENTS = [(0, 10, 1.0, 3), (600, 10, 3.0, 5), (1200, 10, 8.0, 10), (3700, 10, 2.0, 1), (60, 20, 1.0, 7), (4000, 20, 6.0, 2)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=t), u, "click", v, f'{{"k": {k}}}') for i, (t, u, v, k) in enumerate(EVENTS)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


def test_samples_take_all_events_of_the_hour(spark, tables):
    got = {(r["episode_id"], r["frame"]): (r["x"], r["y"]) for r in adapters.samples(spark, tables).collect()}
    assert got == {(10, 0): (4.0, 6.0), (10, 1): (2.0, 1.0), (20, 0): (1.0, 7.0), (20, 1): (6.0, 2.0)}
    speed = {(r["episode_id"], r["frame"]): r["speed"] for r in catalog.queries()["heading_speed"](spark, tables).collect()}
    assert speed[10, 1] == pytest.approx((2**2 + 5**2) ** 0.5, abs=1e-5)


def test_every_event_is_counted(spark, tables):
    run = lambda name: catalog.queries()[name](spark, tables).collect()
    assert sum(r["n"] for r in run("activity_by_hour")) == len(EVENTS)
    assert [(r["episodes"], r["samples"], r["longest"]) for r in run("scene_sizes")] == [(2, 6, 4)]
    assert len(run("chaos_guard")) == len(EVENTS)


def test_boxes_with_equal_edges_are_compared(spark, tables):
    boxes = [((u % 10, t // 3600 % 97), v - 3, k - 3) for t, u, v, k in EVENTS]
    want = []
    for i, (at, x, y) in enumerate(boxes):
        for other, p, q in boxes[:i]:
            if at == other:
                shared = max(6 - abs(x - p), 0) * max(6 - abs(y - q), 0)
                want.append(shared / (72 - shared))
    assert any(a[0] == b[0] and a[1] == b[1] for a, b in zip(boxes, boxes[4:], strict=False))
    (got,) = catalog.queries()["iou_matrix"](spark, tables).collect()
    assert got["n"] == len(want) == 7 and got["max_iou"] == pytest.approx(max(want), abs=1e-5) and got["sum_iou"] == pytest.approx(sum(want), abs=1e-3)
