"""The tables at hand as domain tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import BIO_LABELS

FPS = 100.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_of(user: str):
    return F.element_at(F.array(*[F.lit(x) for x in BIO_LABELS]), (F.floor(F.col(user) / 10) % 5 + 1).cast("int"))


def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, i, v: the events of a user in order of time."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), "ts", "event_id", F.col("value").alias("v"))
    by = W.partitionBy("episode_id").orderBy("ts", "event_id")
    return e.select("episode_id", (F.row_number().over(by) - 1).cast("long").alias("i"), "v")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, episode_id, frame, x, y, scene, label: every event of a user, its frame the hour."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    start = e.agg(F.min("t").alias("t0"))
    e = e.crossJoin(F.broadcast(start)).withColumn("frame", F.floor((F.col("t") - F.col("t0")) / 3600))
    return e.select("event_id", F.col("user_id").alias("episode_id"), "frame", "x", "y", *_places("user_id"))


def _places(user: str) -> list:
    return [F.concat((F.col(user) % 10).cast("string"), F.lit("@"), (F.col(user) % 2).cast("string")).alias("scene"), label_of(user).alias("label")]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, frame, x, y, fps, px_per_cm, scene, label: one sample per user and hour, the mean place of all its events."""
    mean = points(spark, sf_dir).groupBy("episode_id", "frame").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return mean.select("episode_id", "frame", "x", "y", F.lit(1.0).alias("fps"), F.lit(None).cast("double").alias("px_per_cm"), *_places("episode_id"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with their first and last frame."""
    return samples(spark, sf_dir).groupBy("scene", "episode_id", "label", "fps").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))


def annotation_states(events: DataFrame) -> DataFrame:
    """events with qc_state, by their type."""
    states = {"click": "accepted", "view": "unreviewed", "purchase": "rejected", "signup": "edge_effect"}
    kind = F.lit("too_short")
    for event, state in states.items():
        kind = F.when(F.col("event_type") == event, state).otherwise(kind)
    return events.withColumn("qc_state", kind)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an annotation record of its user."""
    k = F.get_json_object("props", "$.k").cast("long")
    label = F.when(k % 7 == 0, None).otherwise(F.element_at(F.array(*[F.lit(x) for x in BIO_LABELS]), (k % 5 + 1).cast("int")))
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return annotation_states(read(spark, sf_dir, "events")).select(F.col("user_id").alias("episode_id"), label.alias("human_label"), F.lit(1.0).alias("human_confidence"), "qc_state", seq.alias("seq"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, z, taxon, motif, grp, label_source of the embeddings."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"), F.col("label").cast("string").alias("taxon"), (F.col("vec_id") % 8).alias("motif"), (F.col("vec_id") % 20).alias("grp"),
        F.when(F.col("vec_id") % 3 == 0, "human").otherwise("machine").alias("label_source"),
    )


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes: region, nation, customer as site, session, video."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_regionkey").alias("site"), F.col("c_nationkey").alias("session"), F.col("c_custkey").alias("video"), F.col("o_orderkey").alias("episode_id"), F.col("o_totalprice").cast("double").alias("value"))


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles to so many digits, negative zero as zero, so that engines agree; nudge moves values off the ties that short decimals have."""
    return df.select(*[(F.round(F.col(n) + nudge, digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


_ARRAY = "['siler','ant','other_spider','other_arthropod','unknown']"

SQL = {
    "vel": "vel AS (SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v FROM events)",
    "trk": f"""ev AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t, value AS x, regexp_extract(props, '(-?[0-9]+)', 1)::DOUBLE AS y FROM events),
evf AS (SELECT *, (t - (SELECT min(t) FROM ev)) // 3600 AS frame FROM ev),
pts AS (SELECT event_id, user_id AS episode_id, frame, x, y, (user_id % 10)::VARCHAR || '@' || (user_id % 2)::VARCHAR AS scene, {_ARRAY}[(user_id // 10) % 5 + 1] AS label FROM evf),
trk AS (SELECT episode_id, frame, scene, label, avg(x) AS x, avg(y) AS y FROM pts GROUP BY episode_id, frame, scene, label)""",
    "ann": f"""ann AS (SELECT user_id AS episode_id, CASE WHEN k % 7 = 0 THEN NULL ELSE {_ARRAY}[k % 5 + 1] END AS human_label,
  CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'unreviewed' WHEN 'purchase' THEN 'rejected' WHEN 'signup' THEN 'edge_effect' ELSE 'too_short' END AS qc_state,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM (SELECT *, regexp_extract(props, '(-?[0-9]+)', 1)::BIGINT AS k FROM events))""",
    "vec": "vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS z, label::VARCHAR AS taxon, vec_id % 8 AS motif, vec_id % 20 AS grp, CASE WHEN vec_id % 3 = 0 THEN 'human' ELSE 'machine' END AS label_source FROM embeddings)",
    "hier": "hier AS (SELECT n_regionkey AS site, c_nationkey AS session, c_custkey AS video, o_orderkey AS episode_id, o_totalprice::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
}
SQL["vfeat"] = SQL["vel"] + """,
vm AS (SELECT *, v > 0.1 * greatest(quantile_cont(v, 0.5) OVER (PARTITION BY episode_id), 1e-9) AS moving, v - lag(v) OVER (PARTITION BY episode_id ORDER BY i) AS dv FROM vel WHERE v IS NOT NULL),
vc AS (SELECT *, CASE WHEN lag(moving) OVER (PARTITION BY episode_id ORDER BY i) = moving THEN 0 ELSE 1 END AS chg FROM vm),
vr AS (SELECT *, (sum(chg) OVER (PARTITION BY episode_id ORDER BY i))::BIGINT AS run FROM vc),
vruns AS (SELECT episode_id, run, any_value(moving) AS moving, count(*) AS n FROM vr GROUP BY ALL),
vpr AS (SELECT episode_id, count(*) FILTER (NOT moving)::DOUBLE AS n_pauses, coalesce(avg(n) FILTER (NOT moving), 0) / 100 AS pause_run_mean_s, coalesce(avg(n) FILTER (moving), 0) / 100 AS move_run_mean_s FROM vruns GROUP BY 1),
vfeat AS (SELECT episode_id, coalesce(sqrt(avg(dv * dv)), 0) * 100 AS accel_rms, 0.0::DOUBLE AS curvature_mean, sum(v) / 100 AS distance, count(*) / 100 AS duration_s, avg(CASE WHEN moving THEN 1.0 ELSE 0.0 END) AS frac_time_moving,
  any_value(move_run_mean_s) AS move_run_mean_s, any_value(n_pauses) AS n_pauses, sum(v) / 100 AS net_displacement, any_value(pause_run_mean_s) AS pause_run_mean_s, 0.0::DOUBLE AS sinuosity,
  CASE WHEN avg(v) > 0 THEN stddev_pop(v) / avg(v) ELSE 0 END AS speed_cv, avg(v) AS speed_mean, quantile_cont(v, 0.9) AS speed_p90, 0.0::DOUBLE AS straightness_index, 0.0::DOUBLE AS turn_rate_mean, 0.0::DOUBLE AS turn_rate_p90
  FROM vr JOIN vpr USING (episode_id) GROUP BY episode_id)"""
SQL["sph"] = SQL["trk"] + """,
sp0 AS (SELECT *, frame - lag(frame) OVER w AS gap, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM trk WINDOW w AS (PARTITION BY episode_id ORDER BY frame)),
sp1 AS (SELECT *, sqrt(dx * dx + dy * dy) / gap AS v_in, CASE WHEN sqrt(dx * dx + dy * dy) > 1e-9 THEN atan2(dy, dx) END AS h_in FROM sp0),
sph AS (SELECT episode_id, frame, x, y, scene, label, coalesce(v_in, lead(v_in) OVER w) AS speed, coalesce(h_in, lead(h_in) OVER w) AS heading FROM sp1 WINDOW w AS (PARTITION BY episode_id ORDER BY frame))"""
SQL["pairs"] = SQL["sph"] + """,
big AS (SELECT scene, episode_id FROM trk GROUP BY ALL HAVING count(*) >= 2),
sphc AS (SELECT * FROM sph WHERE episode_id IN (SELECT episode_id FROM big) AND scene IN (SELECT scene FROM big GROUP BY scene HAVING count(*) >= 2)),
pairs AS (SELECT a.scene, a.frame, a.episode_id AS focal, b.episode_id AS neighbor, a.label AS focal_label, b.label AS neighbor_label, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance,
  a.speed AS focal_speed, b.speed AS neighbor_speed, b.heading AS neighbor_heading, abs(degrees(((b.heading - a.heading + pi()) - 2 * pi() * floor((b.heading - a.heading + pi()) / (2 * pi()))) - pi())) AS hdiff
  FROM sphc a JOIN sphc b ON a.scene = b.scene AND a.frame = b.frame AND a.episode_id <> b.episode_id)"""
SQL["ctx"] = SQL["pairs"] + """,
pf AS (SELECT scene, focal, radius, frame, any_value(focal_label) AS label, min(distance) AS nearest, min(distance) FILTER (neighbor_label = 'ant') AS nearest_ant, count(*) FILTER (distance <= radius) AS n_near,
  count(*) FILTER (distance <= radius AND neighbor_label = 'ant') AS n_ants, avg(neighbor_speed) FILTER (distance <= radius AND neighbor_label = 'ant') AS ant_speed
  FROM pairs, (SELECT unnest([20.0, 40.0, 80.0]::DOUBLE[]) AS radius) GROUP BY ALL),
ctx AS (SELECT scene, focal, radius, any_value(label) AS label, count(*) AS n_frames, avg(nearest) AS nearest_mean, min(nearest_ant) AS nearest_ant_min, avg(n_near) AS mean_near, max(n_ants) AS max_ants, avg(n_ants) AS mean_ants, avg(ant_speed) AS ant_speed,
  avg(CASE WHEN n_ants > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS ant_share, avg(CASE WHEN n_ants > 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AS has_ant FROM pf GROUP BY scene, focal, radius)"""


def sql(select: str, *names: str) -> str:
    """A select over the named expressions; doubles are rounded by the select itself."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + select
