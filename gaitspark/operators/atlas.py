"""Atlas payloads: slim rows, metadata rows, aggregates of the view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slim(episodes: DataFrame, embedded: DataFrame, motifs: DataFrame, neighbors: DataFrame) -> DataFrame:
    """K8: one slim row per episode: place (4 digits), label, motif, its neighbours' ids by rank."""
    near = neighbors.groupBy(F.col("query_id").alias("episode_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("neighbors"))
    rows = episodes.join(embedded.select("episode_id", "z"), "episode_id").join(motifs.select("episode_id", "motif"), "episode_id", "left").join(near, "episode_id", "left")
    return rows.select("episode_id", F.bround(F.get("z", F.lit(0)), 4).alias("x"), F.bround(F.get("z", F.lit(1)), 4).alias("y"), "label", "motif", "neighbors")


def meta(episodes: DataFrame, features: DataFrame) -> DataFrame:
    """K8: what is looked up per episode on demand, as a JSON text."""
    rows = episodes.join(features, "episode_id", "left")
    return rows.select("episode_id", F.to_json(F.struct(*[c for c in rows.columns if c != "episode_id"])).alias("meta"))


def river(episodes: DataFrame, hour: str = "hour", label: str = "label", bins: int = 24) -> DataFrame:
    """Episodes of each label by hour of day, zeros included."""
    cell = F.least(F.lit(bins - 1), F.floor(F.col(hour) * bins / 24)).cast("int")
    got = episodes.where(F.col(hour).isNotNull()).groupBy(cell.alias("bin"), label).agg(F.count("*").alias("n"))
    grid = episodes.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(episodes.select(label).distinct()))
    return grid.join(got, ["bin", label], "left").select("bin", label, F.coalesce("n", F.lit(0)).alias("n"))


def motif_share(assigned: DataFrame) -> DataFrame:
    """Count and share of each motif."""
    g = assigned.groupBy("motif").agg(F.count("*").alias("n"))
    total = assigned.agg(F.count("*").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("motif", "n", (F.col("n") / F.col("total")).alias("share"))


def hero(episodes: DataFrame) -> DataFrame:
    """The episode to show first: reviewed before others, then the longest up to 20 s, ties to the smaller id."""
    return episodes.orderBy(F.desc(F.col("reviewed")), F.desc(F.least(F.col("duration_s"), F.lit(20.0))), "episode_id").limit(1)


def region(points: DataFrame, center: tuple[float, float], radius: float = 90.0, most: int = 50) -> DataFrame:
    """The nearest episodes around a place in the plane."""
    d = F.hypot(F.col("x") - center[0], F.col("y") - center[1])
    return points.withColumn("d", d).where(F.col("d") <= radius).orderBy("d", "episode_id").limit(most)


def with_fallback(rows: DataFrame, main: DataFrame, other: DataFrame) -> DataFrame:
    """Metadata from the first data set that has it."""
    a, b = main.select("episode_id", F.col("meta").alias("m1")), other.select("episode_id", F.col("meta").alias("m2"))
    return rows.join(a, "episode_id", "left").join(b, "episode_id", "left").withColumn("meta", F.coalesce("m1", "m2")).drop("m1", "m2")


def trail(points: DataFrame, most: int = 400) -> DataFrame:
    """L3: the first ``most`` points of each episode as one array."""
    nth = F.row_number().over(W.partitionBy("episode_id").orderBy("frame"))
    kept = points.withColumn("n", nth).where(F.col("n") <= most)
    return kept.groupBy("episode_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("points"))
