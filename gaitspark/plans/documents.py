"""Queries of bundles: what is written is read again, from the newest version."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import interaction as I
from ..operators import labels as L
from ..operators import retrieval as R
from ..session import shared_path
from ..sources import bundles as B
from . import adapters as A
from . import motion, records, scenes

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_ATLAS = A.SQL["lf"] + ",\n" + A.SQL["trk"] + """,
nb AS (SELECT scene, a.episode_id, count(DISTINCT b.episode_id) AS n FROM trk a JOIN trk b USING (scene, frame) WHERE a.episode_id <> b.episode_id GROUP BY ALL)"""


@query(f"WITH {_ATLAS}\nSELECT 'episodes' AS section, episode_id::VARCHAR AS key, label, NULL AS scene, round(distance + 1e-9, 6) AS x, round(speed_mean + 1e-9, 6) AS y, NULL::BIGINT AS neighbors FROM lf UNION ALL SELECT 'meta', episode_id::VARCHAR, NULL, scene, NULL, NULL, n FROM nb")
def stored_atlas(spark, d):
    """K8: slim rows in the document as long as they fit, what is looked up one episode at a time as parts."""
    path = shared_path(spark, "atlas")
    slim = A.rounded(motion.labelled_features(spark, d).select(F.col("episode_id").cast("string").alias("key"), "label", F.col("distance").alias("x"), F.col("speed_mean").alias("y")), nudge=1e-9)
    counts = I.neighbor_counts(A.samples(spark, d), 1)
    meta = counts.select(F.col("focal").cast("string").alias("key"), "scene", "neighbors")
    B.save_frames({"episodes": slim, "meta": meta}, path, ("episodes",))
    got = B.load_frames(spark, path)
    return got["episodes"].select(F.lit("episodes").alias("section"), "*").unionByName(got["meta"].select(F.lit("meta").alias("section"), "*"), allowMissingColumns=True)


@query(scenes.ORACLES["knn_euclidean"])
def stored_query_bundle(spark, d):
    """Hits of the stated queries, written twice, the second time with what the first lacked."""
    path = shared_path(spark, "hits")
    q, index = scenes._split(spark, d)
    about = spark.createDataFrame([(6, "euclidean")], "k int, metric string")
    B.save_frames({"about": about, "hits": R.knn(q.where("id % 100 = 0"), index, 3)}, path, ("about",))
    B.save_frames({"about": about, "hits": A.rounded(R.knn(q, index, 6))}, path, ("about",))
    got = B.load_frames(spark, path)
    return got["hits"].join(F.broadcast(got["about"].where("k = 6 and metric = 'euclidean'").select("k")), F.col("rank") <= F.col("k")).drop("k")


@query(f"SELECT 'labels' AS section, label AS key, n FROM ({records.ORACLES['label_counts']}) UNION ALL SELECT kind, name, n FROM ({motion.ORACLES['annotation_summary']}) UNION ALL SELECT 'sampling', kind, n FROM (UNPIVOT ({motion.ORACLES['hierarchy_summary']}) ON COLUMNS(*) INTO NAME kind VALUE n)")
def stored_summary(spark, d):
    """K5: one document of a run: counts by label, state and source, and the sampling hierarchy."""
    path = shared_path(spark, "summary")
    labels = motion.annotated(spark, d)
    levels = ["sites", "sessions", "videos", "episodes"]
    one = H.distinct_counts(A.hierarchy(spark, d)).select(*levels)
    frames = {"labels": L.label_counts(labels), "annotation": L.annotation_summary(labels), "sampling": one.unpivot([], levels, "kind", "n")}
    B.save_frames(frames, path, tuple(frames))
    got = B.load_frames(spark, path)
    parts = [got["labels"].select(F.lit("labels").alias("section"), F.col("label").alias("key"), "n"), got["annotation"].toDF("section", "key", "n"), got["sampling"].select(F.lit("sampling").alias("section"), F.col("kind").alias("key"), "n")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(scenes.ORACLES["same_video_fraction"])
def stored_evaluation(spark, d):
    """The result of an evaluation as a document."""
    path = shared_path(spark, "evaluation")
    B.save_frames({"same_group": scenes.same_video_fraction(spark, d)}, path, ("same_group",))
    return B.load_frames(spark, path)["same_group"]
