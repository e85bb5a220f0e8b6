"""Entry points end to end on generated tracks."""

import pytest
from pyspark.sql import functions as F

from gaitspark.operators import kinematics
from gaitspark.plans import workflows as X
from gaitspark.sources import bundles, synthetic_tracks


@pytest.fixture(scope="module")
def world(spark):
    samples = synthetic_tracks(spark, 20, 120, seed=9).withColumn("episode_id", F.substring("episode_id", 2, 10).cast("long")).persist()
    features = X.episode_features(samples, None).persist()
    none = F.lit(None).cast("string")
    episodes = samples.groupBy("episode_id").agg(F.first("label").alias("bio_label")).withColumns({"human_label": F.when(F.col("episode_id") < 10, F.col("bio_label")), "human_confidence": F.lit(None).cast("double"), "machine_label": none, "machine_confidence": F.lit(None).cast("double"), "annotation_status": F.lit("accepted")})
    return samples, features, episodes


def test_analyze(world):
    out = X.analyze(world[2], world[1], k=3)
    assert out["embedding"].count() == 20 and out["motifs"].count() == 20
    assert abs(out["motif_profile"].groupBy("label").agg(F.sum("share").alias("s")).agg(F.max(F.abs(F.col("s") - 1))).first()[0]) < 1e-9
    assert out["episodes"].where("machine_label is null").count() == 0 and out["fingerprint"].count() > 0


def test_interact(world):
    samples = world[0]
    spans = samples.groupBy("scene", "episode_id", "label", "fps").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))
    out = X.interact(samples, spans, world[1], 200.0, 20)
    assert out["pairs"].count() == 2 * 90 and out["context"].count() == 20 and out["windows"].count() == 6


def test_reference_and_queries(world, spark, tmp_path):
    ref = X.build_reference(world[2], world[1], min_duration=1.0, dim=4, k=3)
    assert ref["entries"].count() == 20
    queries = world[1].where("episode_id < 3").withColumn("coverage", F.lit(1.0))
    out = X.find_similar(ref, queries, 4, 1.0)
    assert out["hits"].count() == 12 and out["taxa"].count() == 2 and out["breakdown"].count() == 15 and out["novelty"].count() == 3 and out["motifs"].count() == 9
    bundles.save_frames(out, str(tmp_path / "query"), ("taxa", "center"))
    got = bundles.load_frames(spark, str(tmp_path / "query"))
    for name, frame in out.items():
        assert sorted(map(str, got[name].collect())) == sorted(map(str, frame.collect())), name


def test_rotation_keeps_neighbors(world):
    samples = world[0]
    z = kinematics.feature_matrix(world[1])
    from gaitspark.operators import models

    out = X.evaluate_retrieval(samples, samples.select(F.col("episode_id").alias("id"), F.col("scene").alias("grp")).distinct(), models.fit_pca(z, 4), 3)
    assert out["rotate"].agg(F.avg("consistency")).first()[0] > 0.95 and out["translate"].agg(F.avg("consistency")).first()[0] > 0.95


def test_two_stage_costs_less(spark):
    out = {m: df.first() for m, df in X.tracking_benchmark(spark).items()}
    assert out["two-stage"].false_merge_rate == 0 and out["two-stage"].cost < out["greedy"].cost


def test_sampling_summary(spark):
    df = spark.createDataFrame([("A", "s", f"v{i}", float(i)) for i in range(6)], "site string, session string, video string, value double")
    out = X.sampling_summary(df)
    assert out["interval"].first().clusters == 6 and out["tree"].count() == 1
