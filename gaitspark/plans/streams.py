"""Queries that read the events as a stream, for all that is there now."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as S
from ..session import shared_path
from . import adapters as A
from .scenes import hourly_boxes

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark, d):
    # As a pattern, for a stream takes a folder or a pattern, and the table may be one file.
    schema = A.read(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query()
def streamed_tracks(spark, d):
    """T-1, T-2, T-3, T-7, T-11: tracks of the events as they come, and what is left when they end."""
    path = shared_path(spark, "tracks")
    start = A.read(spark, d, "events").agg(F.min(F.unix_timestamp(F.col("ts").cast("timestamp")))).first()[0]
    ahead = 100  # hours, so that times lie behind the epoch; the confidences repeat after as many
    hours = _events(spark, d).withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") - F.lit(start - 3600 * ahead)))
    rows = hours.select("user_id", "ts", F.floor(F.unix_timestamp("ts") / 3600).alias("frame"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    came = S.run_available(S.track_stream(hourly_boxes(rows, "user_id"), 3_600_000, "2 hours"), path)
    points = S.tracks_of(came.unionByName(S.flush_tracks(spark, path)))
    return points.groupBy("video_id", "track").agg((F.min("frame") - ahead).alias("start_frame"), (F.max("frame") - ahead).alias("end_frame"), F.count("*").alias("n"), F.max("parent").alias("parent"))


@query("""WITH w AS (SELECT (user_id % 10)::VARCHAR || '@' || (user_id % 2)::VARCHAR AS scene, user_id, to_timestamp(unnest([floor(epoch(ts) / 10800) * 10800, floor(epoch(ts) / 10800) * 10800 - 10800])) AS start FROM events)
SELECT scene, strftime(start AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS "start", count(DISTINCT user_id)::INT AS episodes, count(*) AS samples FROM w
WHERE epoch(start) + 21600 <= (SELECT epoch(max(ts)) - 7200 FROM events) GROUP BY ALL""")
def streamed_windows(spark, d):
    """T-9: windows of six hours every three, closed two hours behind the last event."""
    rows = _events(spark, d).select(F.concat((F.col("user_id") % 10).cast("string"), F.lit("@"), (F.col("user_id") % 2).cast("string")).alias("scene"), F.col("user_id").alias("episode_id"), "ts")
    got = S.run_available(S.scene_window_stream(rows, "6 hours", "3 hours", "2 hours"), shared_path(spark, "windows"))
    return got.select("scene", _text("start").alias("start"), "episodes", "samples")


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 8 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM (SELECT * FROM g ORDER BY user_id, ts, new DESC))
SELECT user_id AS episode_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "start", strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "last", count(*) AS samples FROM n GROUP BY user_id, visit
HAVING max(ts) + INTERVAL 8 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def streamed_visits(spark, d):
    """T-3: visits that a silence of eight hours ends."""
    rows = _events(spark, d).select(F.col("user_id").alias("episode_id"), "ts")
    got = S.run_available(S.session_stream(rows), shared_path(spark, "visits"))
    return got.select("episode_id", _text("start").alias("start"), _text("last").alias("last"), "samples")
