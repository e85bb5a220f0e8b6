"""The order of an annotation log over appends, old files and failures."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from gaitspark.operators import labels as L
from gaitspark.sources import append_annotations, log, read_annotation_log

RECORD = "episode_id string, human_label string, qc_state string"


def records(spark, rows, parts=1):
    return spark.createDataFrame([(e, label, "accepted") for e, label in rows], RECORD).repartition(parts) if parts > 1 else spark.createDataFrame([(e, label, "accepted") for e, label in rows], RECORD).coalesce(1)


def latest(spark, path):
    return {r.episode_id: r.human_label for r in L.latest_annotations(read_annotation_log(spark, path)).collect()}


def test_later_appends_win_without_seq(spark, tmp_path):
    path = str(tmp_path / "log")
    assert append_annotations(records(spark, [("e1", "ant"), ("e2", "ant"), ("e3", "ant")]), path) == (0, 3)
    assert append_annotations(records(spark, [("e3", "siler")]), path) == (3, 4)
    assert append_annotations(records(spark, []), path) is None
    assert append_annotations(records(spark, [("e1", "siler"), ("e1", "unknown")]), path) == (4, 6)
    assert latest(spark, path) == {"e1": "unknown", "e2": "ant", "e3": "siler"}
    assert [r.seq for r in read_annotation_log(spark, path).orderBy("seq").collect()] == list(range(6))


def test_rows_keep_their_order_over_partitions(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(0, 1000, 1, 7).select(F.lit("e").alias("episode_id"), F.when(F.col("id") == 999, "siler").otherwise("ant").alias("human_label"), F.lit("accepted").alias("qc_state"), F.col("id").cast("string").alias("note"))
    append_annotations(rows, path)
    got = read_annotation_log(spark, path).orderBy("seq").collect()
    assert [int(r.note) for r in got] == list(range(1000)) and [r.seq for r in got] == list(range(1000)) and latest(spark, path) == {"e": "siler"}
    append_annotations(rows.withColumn("seq", -F.col("note").cast("long")), path)
    assert [int(r.note) for r in read_annotation_log(spark, path).where("seq >= 1000").orderBy("seq").collect()] == list(range(999, -1, -1))


@pytest.mark.parametrize("single", [True, False])
def test_old_lines_come_first(spark, tmp_path, single):
    """Files from before there were commits: by time, then place; lines with numbers of their own behind those without."""
    path = tmp_path / ("old.jsonl" if single else "old")
    line = lambda e, label, **more: json.dumps({"episode_id": e, "human_label": label, "qc_state": "accepted", **more})
    first = "\n".join([line("a", "ant"), "", line("a", "siler"), line("b", "ant"), line("c", "ant", seq=9), line("c", "siler", seq=3)]) + "\n"
    if single:
        path.write_text(first)
    else:
        path.mkdir()
        (path / "z.json").write_text(first)
        (path / "a.json").write_text(line("b", "siler") + "\n")
        os.utime(path / "z.json", (time.time() - 100,) * 2)
    assert latest(spark, str(path)) == {"a": "siler", "b": "ant" if single else "siler", "c": "ant"}
    append_annotations(records(spark, [("c", "unknown")]), str(path))
    append_annotations(records(spark, [("a", "unknown")]), str(path))
    assert latest(spark, str(path)) == {"a": "unknown", "b": "ant" if single else "siler", "c": "unknown"}


def test_failed_appends_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    append_annotations(records(spark, [("e1", "ant")]), path)
    with pytest.raises(Exception, match="not in the vocabulary"):
        append_annotations(records(spark, [("e1", "siler"), ("e2", "no such label")], 3), path)
    assert latest(spark, path) == {"e1": "ant"}
    # An append that was written but not committed is not seen either.
    assert len(os.listdir(tmp_path / "log" / "_appends")) >= 1
    append_annotations(records(spark, [("e2", "ant")]), path)
    os.remove(tmp_path / "log" / "_commits" / f"{1:020d}.json")
    assert latest(spark, path) == {"e1": "ant"}


def test_appends_at_once_take_numbers_in_turn(spark, tmp_path, monkeypatch):
    """Another append commits between our look at the log and our commit."""
    path, real, calls = str(tmp_path / "log"), log._create, []

    def late(spark_, where, text):
        calls.append(where)
        if len(calls) == 1:
            append_annotations(records(spark, [("e1", "siler"), ("e2", "siler")]), path)
        return real(spark_, where, text)

    monkeypatch.setattr(log, "_create", late)
    assert append_annotations(records(spark, [("e1", "ant")]), path) == (2, 3)
    assert latest(spark, path) == {"e1": "ant", "e2": "siler"} and len(calls) == 3
