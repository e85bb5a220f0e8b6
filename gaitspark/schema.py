"""Domain vocabulary and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels, review states, roles, detector classes, point states.
BIO_LABELS = ("siler", "ant", "other_spider", "other_arthropod", "unknown")
QC_STATES = ("unreviewed", "accepted", "rejected", "tracking_failure", "severe_occlusion", "edge_effect", "too_short", "ambiguous_taxon")
REJECTED_STATES = ("rejected", "tracking_failure", "severe_occlusion")
ROLES = ("model", "mimic", "phylogenetic_control", "ecological_control", "unknown")

#: Names of the sixteen kinematic features, in the order of a feature vector.
FEATURES = (
    "accel_rms", "curvature_mean", "distance", "duration_s", "frac_time_moving", "move_run_mean_s", "n_pauses", "net_displacement",
    "pause_run_mean_s", "sinuosity", "speed_cv", "speed_mean", "speed_p90", "straightness_index", "turn_rate_mean", "turn_rate_p90",
)

PROVENANCE = T.StructType([T.StructField("step", T.StringType()), T.StructField("model", T.StringType()), T.StructField("version", T.StringType()), T.StructField("timestamp", T.StringType())])

EPISODE = T.StructType([
    T.StructField("episode_id", T.StringType()), T.StructField("source_video_id", T.StringType()), T.StructField("site_id", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("fps", T.DoubleType()), T.StructField("px_per_cm", T.DoubleType()), T.StructField("start_frame", T.LongType()), T.StructField("end_frame", T.LongType()),
    T.StructField("frames", T.ArrayType(T.LongType())), T.StructField("centroids_px", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("bbox_wh_px", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("detection_confidence", T.ArrayType(T.DoubleType())), T.StructField("velocity", T.ArrayType(T.DoubleType())),
    T.StructField("human_label", T.StringType()), T.StructField("human_confidence", T.DoubleType()), T.StructField("machine_label", T.StringType()), T.StructField("machine_confidence", T.DoubleType()),
    T.StructField("bio_label", T.StringType()), T.StructField("bio_label_confidence", T.DoubleType()), T.StructField("bio_label_source", T.StringType()),
    T.StructField("annotation_status", T.StringType()), T.StructField("history", T.ArrayType(PROVENANCE)), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

ANNOTATION = T.StructType([
    T.StructField("episode_id", T.StringType()), T.StructField("human_label", T.StringType()), T.StructField("human_confidence", T.DoubleType()), T.StructField("qc_state", T.StringType()),
    T.StructField("annotator", T.StringType()), T.StructField("note", T.StringType()), T.StructField("source", T.StringType()), T.StructField("timestamp", T.StringType()),
])


def migrate_labels(episodes: DataFrame) -> DataFrame:
    """First-version rows, whose one label goes to the human or the machine side by its source."""
    source, old = F.coalesce("bio_label_source", F.lit("")), F.col("human_label").isNull() & F.col("machine_label").isNull()
    human, machine = old & (source.startswith("human") | source.startswith("dataset")), old & source.startswith("model:")
    return episodes.withColumns({
        "human_label": F.when(human, F.col("bio_label")).otherwise(F.col("human_label")),
        "human_confidence": F.when(human, F.col("bio_label_confidence")).otherwise(F.col("human_confidence")),
        "annotation_status": F.when(human, "accepted").otherwise(F.coalesce("annotation_status", F.lit("unreviewed"))),
        "machine_label": F.when(machine, F.col("bio_label")).otherwise(F.col("machine_label")),
        "machine_confidence": F.when(machine, F.col("bio_label_confidence")).otherwise(F.col("machine_confidence")),
    })


def explode_samples(episodes: DataFrame) -> DataFrame:
    """episode_id, frame, x, y, w, h, conf: the parallel arrays as one row per sample, NaN as null."""
    full = {c: F.coalesce(F.col(c), F.array().cast(EPISODE[c].dataType)) for c in ("frames", "centroids_px", "bbox_wh_px", "detection_confidence")}
    z = F.arrays_zip(full["frames"].alias("frame"), full["centroids_px"].alias("c"), full["bbox_wh_px"].alias("b"), full["detection_confidence"].alias("conf"))
    rows = episodes.select("episode_id", F.explode(z).alias("s"))
    number = lambda c: F.when(~F.isnan(c), c)
    return rows.select(
        "episode_id", F.col("s.frame").alias("frame"), number(F.get("s.c", F.lit(0))).alias("x"), number(F.get("s.c", F.lit(1))).alias("y"),
        F.get("s.b", F.lit(0)).alias("w"), F.get("s.b", F.lit(1)).alias("h"), F.col("s.conf").alias("conf"),
    )
