"""Label layers, annotation logs, roles, files."""

import pytest
from pyspark.sql import functions as F

from gaitspark import schema
from gaitspark.functions import display_hour, effective_label, label_source, normalize_class, provenance_text, shamble_label, to_uint8
from gaitspark.operators import labels as L
from gaitspark.operators.roles import seed_roles
from gaitspark.sources import append_annotations, new_run, read_annotation_log, read_episodes, upsert_motif_annotation

LOG = "episode_id string, human_label string, human_confidence double, qc_state string, seq long"
EP = "episode_id string, human_label string, human_confidence double, machine_label string, bio_label string, annotation_status string"


def test_layers(spark):
    df = spark.createDataFrame([("", None, "ant"), ("siler", "ant", None), (None, "ant", "siler"), (None, "", "")], "human_label string, machine_label string, bio_label string")
    assert [tuple(r) for r in df.select(effective_label(), label_source()).collect()] == [("ant", "unannotated"), ("siler", "human"), ("ant", "machine"), ("unknown", "unannotated")]


def test_latest_wins_and_unknown_ids_do_nothing(spark):
    log = spark.createDataFrame([("e1", "ant", 1.0, "accepted", 1), ("e1", None, None, "rejected", 2), ("zz", "ant", 1.0, "accepted", 3)], LOG)
    eps = spark.createDataFrame([("e1", None, None, "siler", None, "unreviewed"), ("e2", "ant", 0.5, None, None, "accepted")], EP)
    got = {r.episode_id: r for r in L.apply_annotations(eps, log).collect()}
    assert set(got) == {"e1", "e2"} and got["e1"].annotation_status == "rejected" and got["e1"].human_label is None and got["e2"].human_label == "ant"
    assert L.latest_annotations(log, by_layer=True).where("episode_id = 'e1'").first().human_label == "ant"


def test_vocabulary_is_enforced(spark, tmp_path):
    ok = spark.createDataFrame([("e", "ant", 1.0, s, i) for i, s in enumerate(schema.QC_STATES)], LOG)
    append_annotations(ok, str(tmp_path / "log"))
    assert read_annotation_log(spark, str(tmp_path / "log")).count() == 8
    with pytest.raises(Exception, match="vocabulary"):
        append_annotations(ok.withColumn("human_label", F.lit("mimic")), str(tmp_path / "log2"))
    assert read_annotation_log(spark, str(tmp_path / "none")).count() == 0


def test_summary_has_zeros(spark):
    eps = spark.createDataFrame([("e1", "ant", 1.0, None, None, "accepted"), ("e2", None, None, "siler", None, None)], EP)
    got = {(r.kind, r.name): r.n for r in L.annotation_summary(eps).collect()}
    assert got["state", "accepted"] == 1 and got["state", "rejected"] == 0 and got["state", "unreviewed"] == 1 and got["source", "machine"] == 1


def test_policies_and_fallbacks(spark):
    eps = spark.createDataFrame([("a", "accepted", "ant", 5.0), ("b", "rejected", "ant", 5.0), ("c", "unreviewed", None, 5.0), ("d", None, "", 0.5)], "episode_id string, annotation_status string, human_label string, duration_s double")
    ids = lambda c: sorted(r.episode_id for r in eps.where(c).collect())
    s = F.col("duration_s")
    assert ids(L.accepts(s)) == ["a", "c", "d"] and ids(L.accepts(s, "all")) == ["a", "c", "d"] and ids(L.accepts(s, "reviewed", 1.0)) == ["a"] and ids(L.accepts(s, need_human=True)) == ["a"]
    q = eps.select("episode_id", "duration_s", F.lit(0.9).alias("coverage"), F.lit(1.0).alias("distance"))
    assert L.screen_queries(q).where("used").count() == 3 and L.screen_queries(q.where("episode_id = 'd'")).where("used").count() == 1
    assert L.review_queue(eps).count() == 2 and L.review_queue(eps.where("episode_id = 'a'")).count() == 1


def test_roles(spark):
    taxa = spark.createDataFrame([("Siler",), ("Polyrhachis dives",), ("giant wasp",), ("mantis",), ("fly",)], "taxon string")
    got = {r.taxon: r.role for r in L.look_up_roles(taxa, seed_roles(spark)).collect()}
    assert got == {"Siler": "mimic", "Polyrhachis dives": "model", "giant wasp": "model", "mantis": "model", "fly": "unknown"}


def test_files(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    p.write_text('{"episode_id":"a","bio_label":"ant","bio_label_source":"human:x","bio_label_confidence":0.9}\n\n{"episode_id":"b","bio_label":"siler","bio_label_source":"model:y","frames":[1,2],"centroids_px":[[1,2],[3,4]]}\n')
    got = {r.episode_id: r for r in read_episodes(spark, str(p)).collect()}
    assert got["a"].human_label == "ant" and got["a"].annotation_status == "accepted" and got["b"].machine_label == "siler" and got["b"].annotation_status == "unreviewed"
    assert schema.explode_samples(read_episodes(spark, str(p))).count() == 2
    new_run(spark, str(tmp_path / "r"), "r1", "m", "1", {"k": 1})
    assert spark.read.parquet(str(tmp_path / "r/manifest")).count() == 1


def test_small_functions(spark):
    df = spark.createDataFrame([("Ant sp", "1:30 PM", 300.0)], "n string, t string, v double")
    r = df.select(normalize_class(F.col("n")), shamble_label(F.col("n")), display_hour(F.col("t")), to_uint8(F.col("v")), provenance_text(F.array(F.struct(F.lit("a").alias("step"), F.lit("m").alias("model"), F.lit("1").alias("version"))))).first()
    assert tuple(r) == ("ant", None, 13.5, 255, "a m 1")
    notes = spark.createDataFrame([(1, "n" * 100, "x" * 600, "me", "t1"), (1, "new", "y", "me", "t2")], "motif int, name string, notes string, annotator string, timestamp string")
    r = upsert_motif_annotation(notes.limit(1), notes.where("timestamp = 't2'")).first()
    assert r.name == "new"
