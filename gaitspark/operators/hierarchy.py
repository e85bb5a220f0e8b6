"""Sampling hierarchy: counts and the bootstrap of a mean; bootstrap.py has other statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ranked

LEVELS = ("site", "session", "video")


def counts(episodes: DataFrame) -> DataFrame:
    """A5: episodes per (site, session, video) and all totals above, by rollup; level is how many keys a row has."""
    return episodes.rollup(*LEVELS).agg(F.count("*").alias("n"), F.grouping_id().alias("g")).select(*LEVELS, "n", (3 - F.expr("bit_count(g)")).cast("int").alias("level"))


def tree(episodes: DataFrame) -> DataFrame:
    """A5 as one nested map per site."""
    videos = episodes.groupBy(*LEVELS).agg(F.count("*").alias("n"))
    sessions = videos.groupBy("site", "session").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("video", "n")))).alias("videos"))
    return sessions.groupBy("site").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("session", F.to_json("videos"))))).alias("sessions"))


def distinct_counts(episodes: DataFrame) -> DataFrame:
    """Distinct sites, sessions within sites, videos within sessions, and episodes."""
    return episodes.agg(
        F.count_distinct("site").alias("sites"), F.count_distinct(F.struct("site", "session")).alias("sessions"), F.count_distinct(F.struct(*LEVELS)).alias("videos"), F.count("*").alias("episodes"),
    )


def auto_level(episodes: DataFrame) -> str:
    """The highest level with two clusters or more, else the lowest."""
    r = distinct_counts(episodes).first()
    return "site" if r["sites"] >= 2 else "session" if r["sessions"] >= 2 else "video"


def mixed_hash(b: Column, j: Column) -> Column:
    """A draw of 0 to about 306 million from two small numbers, the same in any engine with 64-bit integers."""
    m = F.lit(2147483647)
    x = ((b * 48271 + j * 69621 + 12345) % m) * 16807 % m
    y = (x % 46337) * (F.floor(x / 46337) + 1) % m
    return F.floor((y * 48271 % m) / 7)


def bootstrap_mean(episodes: DataFrame, value: str, cluster: Column, replicates: int = 500) -> DataFrame:
    """A7 with arithmetic draws: estimate, lo, hi, clusters of the mean over whole resampled clusters.

    Clusters are numbered in the order of their keys; a replicate draws as many as
    there are. The draw table holds (replicate, cluster, times); sums are per cluster,
    so the join multiplies clusters, never rows.
    """
    per = episodes.withColumn("cluster", cluster).groupBy("cluster").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    size = per.agg(F.count("*").alias("k"), (F.sum("s") / F.sum("n")).alias("estimate"))
    numbered = ranked(per, "cluster")
    k = size.first()["k"]
    draws = episodes.sparkSession.range(replicates).select(F.col("id").alias("b")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(k - 1, 0)).cast("long"))))
    draws = draws.select("b", (mixed_hash(F.col("b"), F.col("j")) % max(k, 1)).alias("no")).groupBy("b", "no").agg(F.count("*").alias("times"))
    means = draws.join(numbered, "no").groupBy("b").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("m"))
    ci = means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return size.crossJoin(ci).select("estimate", "lo", "hi", F.col("k").alias("clusters"))
