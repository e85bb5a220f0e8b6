"""Run folders, episode files, annotation logs, index versions and model rows.

All writes are appends of partitioned tables, so a rerun never rewrites what others read.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.models import Projection
from ..operators.roles import ROLE, seed_roles
from ..schema import EPISODE, migrate_labels
from .log import append_annotations, exists, read_annotation_log  # noqa: F401


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, blank lines skipped, first-version labels migrated; unknown keys are left out."""
    return migrate_labels(spark.read.schema(EPISODE).json(path).where("episode_id is not null"))


def write_episodes(episodes: DataFrame, path: str) -> None:
    """K2."""
    episodes.write.mode("append").json(path)


def new_run(spark: SparkSession, root: str, run_id: str, model: str, version: str, parameters: dict, parent: str | None = None) -> str:
    """K1: a manifest row for a fresh run; returns the run's folder."""
    row = [(run_id, model, version, json.dumps(parameters, sort_keys=True), parent)]
    spark.createDataFrame(row, "run_id string, model string, version string, parameters string, parent string").withColumn("created", F.current_timestamp()).write.mode("append").parquet(f"{root}/manifest")
    return f"{root}/runs"


def append_runs(rows: DataFrame, path: str, run_id: str) -> None:
    """K1, K6: rows of a run, in the run's own partition."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def upsert_motif_annotation(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest by motif; names of 80 and notes of 500 characters at most."""
    cut = lambda d: d.select("motif", F.substring("name", 1, 80).alias("name"), F.substring("notes", 1, 500).alias("notes"), "annotator", "timestamp")
    both = cut(old).unionByName(cut(new))
    return both.withColumn("n", F.row_number().over(W.partitionBy("motif").orderBy(F.desc("timestamp"), "name"))).where("n = 1").drop("n")


def save_index(entries: DataFrame, path: str, version: str) -> None:
    """K7: entries of an index version, which is a UTC time in microseconds, so that the newest is the largest."""
    entries.withColumn("version_id", F.lit(version)).write.mode("append").partitionBy("version_id").parquet(path)


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version; only its folder is read."""
    schema = spark.read.parquet(path).drop("version_id").schema.add("version_id", "string")  # never a number
    rows = spark.read.schema(schema).parquet(path)
    last = rows.agg(F.max("version_id")).first()[0]
    return rows.where(F.col("version_id") == last)


def save_model(spark: SparkSession, path: str, name: str, model: Projection) -> None:
    """K7: one row per model."""
    row = [(name, model.mean.tolist(), model.spread.tolist(), model.components.tolist(), model.explained.tolist(), model.checksum())]
    spark.createDataFrame(row, "name string, mean array<double>, spread array<double>, components array<array<double>>, explained array<double>, checksum string").write.mode("append").parquet(path)


def read_model(spark: SparkSession, path: str, name: str) -> Projection:
    """Raises where the stored checksum doesn't fit."""
    r = spark.read.parquet(path).where(F.col("name") == name).first()
    model = Projection(np.array(r["mean"]), np.array(r["spread"]), np.array(r["components"]), np.array(r["explained"]))
    if model.checksum() != r["checksum"]:
        raise ValueError(f"model {name} is damaged")
    return model


def write_json(rows: DataFrame, path: str) -> None:
    """A small payload as one JSON file per partition."""
    rows.write.mode("append").json(path)


# --- small documents: read where they are, defaults where they are missing -----------------


def _document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    if not exists(spark, path):
        return None
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_projection(spark: SparkSession, path: str) -> Projection | None:
    """The plane of an atlas (mu, sd, components, explained) as a projection; None if the file is missing."""
    doc = _document(spark, path, "mu array<double>, sd array<double>, components array<array<double>>, explained array<double>")
    r = doc.first() if doc is not None else None
    return None if r is None else Projection(np.array(r["mu"]), np.array(r["sd"]), np.array(r["components"]), np.array(r["explained"] or []))


def write_projection(spark: SparkSession, model: Projection, path: str) -> None:
    """K8: the plane beside the slim rows."""
    row = [(model.mean.tolist(), model.spread.tolist(), model.components.tolist(), model.explained.tolist())]
    spark.createDataFrame(row, "mu array<double>, sd array<double>, components array<array<double>>, explained array<double>").coalesce(1).write.mode("overwrite").json(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame | None:
    """One row with available, n_records and n_scene_windows of an interaction summary; not available if the file is missing."""
    doc = _document(spark, path, "n_records long, n_scene_windows long, n_velocity_excluded long")
    if doc is None:
        return spark.createDataFrame([(False, 0, 0, 0)], "available boolean, n_records long, n_scene_windows long, n_velocity_excluded long")
    return doc.fillna(0).select(F.lit(True).alias("available"), "*")


def read_roles(spark: SparkSession, path: str) -> DataFrame:
    """A curated registry, its roles as rows; the seed registry if the file is missing."""
    names = [f.split(" ")[0] for f in ROLE.split(", ")]
    stored = {"system": "mimicry_system_id", "source": "reference_source"}
    fields = ", ".join(f"{stored.get(n, n)}: {'double' if n == 'confidence' else 'string'}" for n in names)
    doc = _document(spark, path, f"roles array<struct<{fields}>>")
    if doc is None:
        return seed_roles(spark)
    return doc.select(F.explode("roles").alias("r")).select(*[F.col(f"r.{stored.get(n, n)}").alias(n) for n in names])


def write_roles(roles: DataFrame, path: str) -> None:
    """The registry, a dimension table of a few hundred rows, as one document with the time it was saved."""
    stored = {"system": "mimicry_system_id", "source": "reference_source"}
    one = F.struct(*[F.col(c).alias(stored.get(c, c)) for c in roles.columns])
    roles.agg(F.sort_array(F.collect_list(one)).alias("roles")).withColumn("saved_utc", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)


def read_motif_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Names and notes of motifs; none if the file is missing."""
    schema = "motif long, name string, notes string, annotator string, timestamp string"
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_ratings(ratings: DataFrame, path: str) -> None:
    """Ratings of query hits (query_id, episode_id, rating from 1 to 5, note) with the time they came; a rating outside the range fails."""
    ok = F.col("rating").between(1, 5)
    checked = F.when(ok, F.col("rating")).otherwise(F.raise_error(F.concat(F.lit("no rating from 1 to 5: "), F.coalesce(F.col("rating").cast("string"), F.lit("null")))))
    ratings.select("query_id", "episode_id", checked.cast("int").alias("rating"), F.substring("note", 1, 500).alias("note")).withColumn("rated", F.current_timestamp()).write.mode("append").json(path)
