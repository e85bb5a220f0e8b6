"""Queries of kinematics, labels, hierarchy and statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import effective_label, heuristic_label, label_source
from ..operators import bootstrap as B
from ..operators import hierarchy as H
from ..operators import kinematics as K
from ..operators import labels as L
from ..operators import models as M
from ..operators import stats as S
from ..operators.roles import SEED_ROLES, seed_roles
from ..schema import FEATURES, QC_STATES, REJECTED_STATES
from ..session import settled
from . import adapters as A

QUERIES: dict = {}
ORACLES: dict = {}
FPS = A.FPS
_R = lambda names: ", ".join(f"round({n} + 1e-9, 6) AS {n}" for n in names)
DIMS = ("speed_mean", "speed_cv", "frac_time_moving", "accel_rms", "speed_p90", "move_run_mean_s")
GROUPS = {"trajectory_geometry": ("distance",), "speed_dynamics": ("speed_mean", "speed_p90", "accel_rms"), "stop_go_rhythm": ("frac_time_moving", "n_pauses", "pause_run_mean_s", "move_run_mean_s"), "intermittency": ("speed_cv",)}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def labelled_features(spark: SparkSession, d: str) -> DataFrame:
    return K.velocity_features(A.velocity(spark, d)).withColumn("label", A.label_of("episode_id"))


_LF = "lf AS (SELECT *, ['siler','ant','other_spider','other_arthropod','unknown'][(episode_id // 10) % 5 + 1] AS label FROM vfeat)"
A.SQL["lf"] = A.SQL["vfeat"] + ",\n" + _LF


@query(A.sql(f"SELECT episode_id, {_R(FEATURES)} FROM vfeat", "vfeat"))
def velocity_features(spark, d):
    """A2."""
    return A.rounded(K.velocity_features(A.velocity(spark, d)), nudge=1e-9)


@query(A.sql(f"SELECT episode_id, {_R([f for f in FEATURES if f not in ('n_pauses', 'pause_run_mean_s')])}, 0.0::DOUBLE AS n_pauses, 0.0::DOUBLE AS pause_run_mean_s FROM vfeat", "vfeat"))
def velocity_features_compat(spark, d):
    """A2 as published, without pauses."""
    return A.rounded(K.velocity_features(A.velocity(spark, d), compat=True), nudge=1e-9)


@query(A.sql("SELECT episode_id, run, moving, n FROM vruns", "vfeat"))
def run_lengths(spark, d):
    """W5."""
    return K.run_lengths(K.moving_flags(A.velocity(spark, d).where("v is not null")), "i", "moving")


_STEPS = """,
dl AS (SELECT episode_id, frame - lag(frame) OVER (PARTITION BY episode_id ORDER BY frame) AS delta FROM trk),
dc AS (SELECT episode_id, delta, count(*) AS n FROM dl GROUP BY ALL),
md AS (SELECT episode_id, coalesce((list(delta ORDER BY n DESC, delta) FILTER (delta IS NOT NULL))[1], 1) AS step FROM dc GROUP BY 1)"""
A.SQL["steps"] = A.SQL["trk"] + _STEPS


@query(A.sql("SELECT episode_id, step FROM md", "steps"))
def modal_frame_step(spark, d):
    """W2."""
    return K.modal_step(A.samples(spark, d))


_TRAJ = A.SQL["steps"] + """,
s0 AS (SELECT trk.*, step, frame - lag(frame) OVER w AS delta, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM trk JOIN md USING (episode_id) WINDOW w AS (PARTITION BY episode_id ORDER BY frame)),
s1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS len, coalesce(abs(delta - step) <= greatest(1, round_even(step * 0.25, 0)), false) AS valid, atan2(dy, dx) AS heading FROM s0),
s2 AS (SELECT *, CASE WHEN valid THEN len / step END AS v, heading - lag(heading) OVER w AS dh, lag(valid) OVER w AS vb FROM s1 WINDOW w AS (PARTITION BY episode_id ORDER BY frame)),
s3 AS (SELECT *, CASE WHEN valid AND vb THEN abs((dh + pi()) - 2 * pi() * floor((dh + pi()) / (2 * pi())) - pi()) END AS turn FROM s2),
g AS (SELECT episode_id, count(*) AS points, any_value(step)::DOUBLE AS dt, arg_min(x, frame) AS x0, arg_min(y, frame) AS y0, arg_max(x, frame) AS x1, arg_max(y, frame) AS y1, sum(len) FILTER (valid) AS path,
  avg(turn / step) AS turn_rate_mean, quantile_cont(turn / step, 0.9) AS turn_rate_p90, avg(turn / greatest(len, 1e-9)) AS curvature_mean, quantile_cont(v, 0.9) AS speed_p90 FROM s3 GROUP BY 1 HAVING count(*) >= 2),
k0 AS (SELECT *, v > greatest(0.1 * quantile_cont(v, 0.5) OVER (PARTITION BY episode_id), 1e-9) AS moving, v - lag(v) OVER (PARTITION BY episode_id ORDER BY frame) AS dv FROM s3 WHERE valid),
k1 AS (SELECT *, CASE WHEN lag(moving) OVER (PARTITION BY episode_id ORDER BY frame) = moving THEN 0 ELSE 1 END AS chg FROM k0),
k2 AS (SELECT *, sum(chg) OVER (PARTITION BY episode_id ORDER BY frame) AS run FROM k1),
kr AS (SELECT episode_id, run, any_value(moving) AS moving, count(*) AS n FROM k2 GROUP BY ALL),
kp AS (SELECT episode_id, count(*) FILTER (NOT moving)::DOUBLE AS n_pauses, coalesce(avg(n) FILTER (NOT moving), 0) AS pause_run, coalesce(avg(n) FILTER (moving), 0) AS move_run FROM kr GROUP BY 1),
ks AS (SELECT episode_id, sqrt(avg(dv * dv)) AS dv_rms, avg(CASE WHEN moving THEN 1.0 ELSE 0.0 END) AS frac_time_moving, CASE WHEN avg(v) > 0 THEN stddev_pop(v) / avg(v) ELSE 0 END AS speed_cv, avg(v) AS speed_mean FROM k2 GROUP BY 1),
tf AS (SELECT e.episode_id, points, dv_rms / dt AS accel_rms, curvature_mean, coalesce(path, 0) AS distance, points * dt AS duration_s, frac_time_moving, move_run AS move_run_mean_s, n_pauses, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS net_displacement,
  pause_run AS pause_run_mean_s, coalesce(path, 0) / greatest(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 1e-9) AS sinuosity, speed_cv, speed_mean, speed_p90, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / greatest(coalesce(path, 0), 1e-9) AS straightness_index, turn_rate_mean, turn_rate_p90
  FROM (SELECT DISTINCT episode_id FROM trk) e LEFT JOIN g USING (episode_id) LEFT JOIN kp USING (episode_id) LEFT JOIN ks USING (episode_id))"""


@query("WITH " + _TRAJ + "\nSELECT episode_id, " + ", ".join(f"round(coalesce({f}, 0), 6)::DOUBLE AS {f}" for f in FEATURES) + " FROM tf")
def trajectory_features(spark, d):
    """A1."""
    return A.rounded(K.trajectory_features(A.samples(spark, d)))


@query(A.sql("SELECT episode_id, frame, round(speed, 6) AS speed, round(heading, 6) AS heading FROM sph", "sph"))
def heading_speed(spark, d):
    """W7, W8."""
    return A.rounded(K.frame_speed_heading(A.samples(spark, d)).select("episode_id", "frame", "speed", "heading"))


@query(A.sql("SELECT episode_id, i, round(v, 6) AS v FROM (SELECT *, count(*) OVER (PARTITION BY episode_id) AS n FROM vel) WHERE n <= 20 OR i IN (SELECT unnest(list_transform(range(20), lambda j: (j * (n - 1)) // 19)))", "vel"))
def resample_series(spark, d):
    """W12."""
    return A.rounded(K.resample(A.velocity(spark, d), "i", 20).select("episode_id", "i", "v"))


@query(A.sql("SELECT episode_id, i, round((v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-9), 6) AS z FROM vel WINDOW w AS (PARTITION BY episode_id)", "vel"))
def zscore_series(spark, d):
    """W14."""
    v = A.velocity(spark, d)
    from ..functions.geometry import population_z

    return A.rounded(v.select("episode_id", "i", population_z(F.col("v"), K.episode()).alias("z")))


@query(A.sql("""SELECT episode_id, w AS "window", count(*)::DOUBLE / 100 AS duration_s, round(avg(v), 6) AS speed_mean, round(quantile_cont(v, 0.9), 6) AS speed_p90 FROM
 (SELECT vel.*, unnest(range(greatest(0, (i - 40 + 20) // 20)::BIGINT, least(CASE WHEN n <= 40 THEN 0 ELSE (n - 40) // 20 END, i // 20)::BIGINT + 1)) AS w FROM (SELECT *, count(*) OVER (PARTITION BY episode_id) AS n FROM vel) vel) GROUP BY 1, 2 HAVING count(*) >= 10""", "vel"))
def sliding_window_features(spark, d):
    """W10."""
    out = K.sliding_windows(A.velocity(spark, d), window_s=0.4, stride_s=0.2)
    return A.rounded(out.select("episode_id", "window", "duration_s", "speed_mean", "speed_p90"))


# --- labels ---------------------------------------------------------------------


@query(A.sql("SELECT episode_id, human_label, qc_state FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seq DESC) AS rn FROM ann) WHERE rn = 1", "ann"))
def annotation_latest(spark, d):
    """J5."""
    return L.latest_annotations(A.annotations(spark, d)).select("episode_id", "human_label", "qc_state")


@query(A.sql("SELECT episode_id, (list(human_label ORDER BY seq DESC) FILTER (human_label IS NOT NULL))[1] AS human_label, (list(qc_state ORDER BY seq DESC))[1] AS qc_state FROM ann GROUP BY 1", "ann"))
def annotation_layers(spark, d):
    """J5 by layer: a later state does not hide an earlier label."""
    return L.latest_annotations(A.annotations(spark, d), by_layer=True).select("episode_id", "human_label", "qc_state")


def annotated(spark, d):
    e = A.spans(spark, d).select("episode_id", (F.col("end_frame") - F.col("start_frame")).cast("double").alias("duration_s"), F.lit(None).cast("string").alias("human_label"), F.lit(None).cast("double").alias("human_confidence"), F.lit("unreviewed").alias("annotation_status"), F.when(F.col("episode_id") % 4 == 0, "").otherwise(F.col("label")).alias("machine_label"), F.lit("ant").alias("bio_label"))
    return L.apply_annotations(e, A.annotations(spark, d))


A.SQL["annotated"] = A.SQL["trk"] + ",\n" + A.SQL["ann"] + """,
annotated AS (SELECT e.episode_id, duration_s, human_label, qc_state AS annotation_status, CASE WHEN e.episode_id % 4 = 0 THEN '' ELSE label END AS machine_label, 'ant' AS bio_label FROM
  (SELECT episode_id, label, (max(frame) - min(frame))::DOUBLE AS duration_s FROM trk GROUP BY ALL) e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seq DESC) AS rn FROM ann) a ON a.episode_id = e.episode_id AND rn = 1)"""
_EFF = "coalesce(nullif(human_label, ''), nullif(machine_label, ''), nullif(bio_label, ''), 'unknown')"
_SRC = "CASE WHEN nullif(human_label, '') IS NOT NULL THEN 'human' WHEN nullif(machine_label, '') IS NOT NULL THEN 'machine' ELSE 'unannotated' END"


@query(A.sql(f"SELECT episode_id, {_EFF} AS label, {_SRC} AS source FROM annotated", "annotated"))
def effective_labels(spark, d):
    """P1, P2."""
    return annotated(spark, d).select("episode_id", effective_label().alias("label"), label_source().alias("source"))


@query(A.sql(f"""SELECT 'state' AS kind, s AS name, count(episode_id) AS n FROM (SELECT unnest({list(QC_STATES)}) AS s) LEFT JOIN annotated ON annotation_status = s GROUP BY s
UNION ALL SELECT 'label', {_EFF}, count(*) FROM annotated GROUP BY 2 UNION ALL SELECT 'source', {_SRC}, count(*) FROM annotated GROUP BY 2""", "annotated"))
def annotation_summary(spark, d):
    """A4."""
    return L.annotation_summary(annotated(spark, d))


@query(A.sql(f"""SELECT episode_id, annotation_status NOT IN {REJECTED_STATES} AND duration_s >= 100 AS lenient, annotation_status = 'accepted' AND duration_s >= 100 AS reviewed,
annotation_status NOT IN {REJECTED_STATES} AND nullif(human_label, '') IS NOT NULL AS human FROM annotated""", "annotated"))
def index_policy(spark, d):
    """P3."""
    s = F.col("duration_s")
    return annotated(spark, d).select("episode_id", L.accepts(s, min_duration=100).alias("lenient"), L.accepts(s, "reviewed", 100).alias("reviewed"), L.accepts(s, need_human=True).alias("human"))


@query(A.sql("""SELECT episode_id, reasons, reasons = '' OR NOT (SELECT bool_or(reasons = '') FROM q) AS used FROM q""".replace("SELECT episode_id", "SELECT episode_id", 1), "vfeat").replace("\nSELECT episode_id", """,
q AS (SELECT episode_id, array_to_string(list_filter([CASE WHEN duration_s < 0.6 THEN 'short' END, CASE WHEN frac_time_moving < 0.7 THEN 'low_coverage' END, CASE WHEN distance < 1e-6 THEN 'no_motion' END], lambda x: x IS NOT NULL), ',') AS reasons FROM vfeat)
SELECT episode_id""", 1))
def query_qc(spark, d):
    """P4, P5."""
    rows = K.velocity_features(A.velocity(spark, d)).withColumn("coverage", F.col("frac_time_moving"))
    return L.screen_queries(rows, 0.6).select("episode_id", F.array_join("reasons", ",").alias("reasons"), "used")


@query(A.sql("""SELECT episode_id, CASE WHEN score > 0.6 THEN 'ant' WHEN score < 0.4 THEN 'siler' ELSE 'unknown' END AS machine_label,
round(CASE WHEN score > 0.6 THEN least(0.95, 0.5 + 0.5 * (score - 0.6)) WHEN score < 0.4 THEN least(0.9, 0.5 + 0.3 * (0.4 - score)) ELSE 0.3 END, 6) AS confidence
FROM (SELECT episode_id, ln(1.0 + (episode_id % 7)) - 0.35 * (speed_cv + n_pauses / greatest(duration_s, 1e-9) / 20) AS score FROM vfeat)""", "vfeat"))
def heuristic_labels(spark, d):
    """P11, with an aspect made of the id."""
    f = K.velocity_features(A.velocity(spark, d))
    label, sure = heuristic_label(1.0 + F.col("episode_id") % 7, F.col("speed_cv"), F.col("n_pauses") / 20, F.col("duration_s"))
    return A.rounded(f.select("episode_id", label.alias("machine_label"), sure.cast("double").alias("confidence")))


_TAXA = ["ant", "Lasius niger", "Siler", "Siler collingwoodi", "Polyrhachis", "Mantis", "Salticus senicus ", "fly", "giant beetle"]


@query(f"""WITH taxa AS (SELECT unnest({_TAXA}) AS taxon), roles(known, role) AS (VALUES {", ".join(f"('{t.lower()}', '{r}')" for t, r, *_ in SEED_ROLES)}),
k AS (SELECT taxon, lower(trim(taxon)) AS key FROM taxa),
h AS (SELECT taxon, known, role, row_number() OVER (PARTITION BY taxon ORDER BY key <> known, -length(known), known, role) AS rn FROM k JOIN roles ON starts_with(key, known) OR starts_with(known, key))
SELECT k.taxon, coalesce(h.role, CASE WHEN contains(key, 'ant') THEN 'model' END, 'unknown') AS role, known AS matched FROM k LEFT JOIN h ON h.taxon = k.taxon AND rn = 1""")
def role_lookup(spark, d):
    """P17."""
    return L.look_up_roles(spark.createDataFrame([(t,) for t in _TAXA], "taxon string"), seed_roles(spark))


# --- hierarchy and statistics -----------------------------------------------------


@query(A.sql("""SELECT site, session, video, count(*) AS n, ((site IS NOT NULL)::INT + (session IS NOT NULL)::INT + (video IS NOT NULL)::INT) AS level FROM hier GROUP BY ROLLUP (site, session, video)""", "hier"))
def hierarchy_counts(spark, d):
    """A5."""
    return H.counts(A.hierarchy(spark, d))


@query(A.sql("SELECT count(DISTINCT site) AS sites, count(DISTINCT (site, session)) AS sessions, count(DISTINCT (site, session, video)) AS videos, count(*) AS episodes FROM hier", "hier"))
def hierarchy_summary(spark, d):
    """A6."""
    return H.distinct_counts(A.hierarchy(spark, d))


_HASH = "((({y}) * 48271 % 2147483647) // 7)".format(y="((x % 46337) * ((x // 46337) + 1) % 2147483647)")
_X = "((({b} * 48271 + {j} * 69621 + 12345) % 2147483647) * 16807 % 2147483647)"


@query(A.sql("""SELECT round((SELECT sum(s) / sum(n) FROM per), 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, (SELECT count(*) FROM per) AS clusters FROM means""", "hier").replace("\nSELECT round", f""",
per AS (SELECT session, sum(value) AS s, count(value) AS n FROM hier GROUP BY 1), num AS (SELECT *, row_number() OVER (ORDER BY session) - 1 AS no FROM per),
dr AS (SELECT b, {_X.format(b='b', j='j')} AS x FROM range(500) t(b), (SELECT no AS j FROM num)), dw AS (SELECT b, {_HASH} % (SELECT count(*) FROM per) AS no FROM dr),
means AS (SELECT b, sum(s) / sum(n) AS m FROM dw JOIN num USING (no) GROUP BY b)
SELECT round""", 1))
def cluster_bootstrap(spark, d):
    """A7 over nations."""
    return A.rounded(H.bootstrap_mean(A.hierarchy(spark, d), "value", F.col("session")))


@query()
def bootstrap_statistics(spark, d):
    """Mean, median, 0.9 quantile and a correlation of prices, with nations drawn whole."""
    rows = A.hierarchy(spark, d).withColumn("size", F.col("episode_id") % 1000 + F.col("value") / 1000)
    stats = {"mean": B.Mean("value"), "median": B.Quantile("value", 0.5), "p90": B.Quantile("value", 0.9), "correlation": B.Correlation("value", "size", (150_000.0, 650.0))}
    return A.rounded(B.bootstrap(rows, stats, "session", 200))


_LONG = ", ".join(f"({n!r}, {n})" for n in DIMS)


def _sides(spark, d):
    f = labelled_features(spark, d).where("label in ('siler', 'ant')")
    long = f.unpivot(["episode_id", "label"], list(DIMS), "dim", "value")
    return long.select("episode_id", "dim", "value", F.when(F.col("label") == "siler", "a").otherwise("b").alias("side"))


A.SQL["long"] = A.SQL["lf"] + f",\nall_long AS (SELECT episode_id, label, u.dim, u.value FROM lf, LATERAL (SELECT * FROM (VALUES {_LONG}) t(dim, value)) u),\nlong AS (SELECT episode_id, dim, value, CASE WHEN label = 'siler' THEN 'a' ELSE 'b' END AS side FROM all_long WHERE label IN ('siler', 'ant'))"


def _overlap_sql(src: str, out: str) -> str:
    return f""",
{out}_s AS (SELECT dim, min(value) AS lo, max(value) AS hi, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM {src} GROUP BY 1),
{out}_b AS (SELECT dim, lo, hi, na, nb, greatest(0, least(23, floor((value - lo) / ((hi - lo) / 24)))) AS bin, count(*) FILTER (side = 'a') AS ca, count(*) FILTER (side = 'b') AS cb FROM {src} JOIN {out}_s USING (dim) WHERE hi - lo >= 1e-12 GROUP BY ALL),
{out} AS (SELECT dim, na, nb, CASE WHEN na > 0 AND nb > 0 THEN overlap END AS overlap FROM {out}_s LEFT JOIN (SELECT dim, sum(sqrt(ca / (na * ((hi - lo) / 24)) * (cb / (nb * ((hi - lo) / 24)))) * ((hi - lo) / 24)) AS overlap FROM {out}_b GROUP BY 1) USING (dim))"""


@query("WITH " + A.SQL["long"] + _overlap_sql("long", "ov") + "\nSELECT dim, na, nb, round(overlap, 6) AS overlap FROM ov")
def overlap_coefficient(spark, d):
    """A10."""
    return A.rounded(S.overlap(_sides(spark, d), ["dim"]))


@query("WITH " + A.SQL["long"] + ",\nlm AS (SELECT dim, value, side FROM long), lo AS (SELECT dim, value, CASE WHEN label = 'siler' THEN 'a' ELSE 'b' END AS side FROM all_long WHERE label <> 'ant')" + _overlap_sql("lm", "om") + _overlap_sql("lo", "oo")
       + "\nSELECT dim, om.nb AS n_model, round(CASE WHEN om.na >= 3 AND om.nb >= 3 THEN om.overlap END, 6) AS overlap_model, oo.nb AS n_others, round(CASE WHEN oo.na >= 3 AND oo.nb >= 3 THEN oo.overlap END, 6) AS overlap_others FROM om JOIN oo USING (dim)")
def mimicry_fingerprint(spark, d):
    """A11."""
    return A.rounded(S.fingerprint(labelled_features(spark, d), DIMS))


_PERM = f""",
pj AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY episode_id) - 1 AS j, count(*) FILTER (side = 'a') OVER (PARTITION BY dim) AS n_a, count(*) OVER (PARTITION BY dim) AS n FROM long),
rl AS (SELECT dim, any_value(n_a) AS n_a, any_value(n - n_a) AS n_b, quantile_cont(value, 0.5) FILTER (side = 'a') AS median_a, quantile_cont(value, 0.5) FILTER (side = 'b') AS median_b FROM pj GROUP BY 1),
px AS (SELECT pj.*, b, {_X.format(b='b', j='j')} AS x FROM pj, range(200) t(b)),
ph AS (SELECT *, row_number() OVER (PARTITION BY dim, b ORDER BY {_HASH}, j) <= n_a AS first FROM px),
nl AS (SELECT dim, b, quantile_cont(value, 0.5) FILTER (first) - quantile_cont(value, 0.5) FILTER (NOT first) AS dd FROM ph GROUP BY ALL),
pp AS (SELECT dim, quantile_cont(dd, 0.025) AS null_lo, quantile_cont(dd, 0.975) AS null_hi, (count(*) FILTER (abs(dd) >= abs(median_a - median_b) - 1e-12) + 1) / 201 AS p_perm FROM nl JOIN rl USING (dim) GROUP BY 1)"""


@query("WITH " + A.SQL["long"] + _PERM + "\nSELECT dim, n_a, n_b, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b, round(median_a - median_b, 6) AS diff, round(null_lo, 6) AS null_lo, round(null_hi, 6) AS null_hi, round(p_perm, 6) AS p_perm FROM rl JOIN pp USING (dim)")
def permutation_contrast(spark, d):
    """A17."""
    return A.rounded(S.permutation_contrast(_sides(spark, d), ["dim"], order="episode_id"))


@query("WITH " + A.SQL["long"] + """,
rk AS (SELECT dim, side, rank() OVER (PARTITION BY dim ORDER BY value) + (count(*) OVER (PARTITION BY dim, value) - 1) / 2.0 AS r FROM long),
nn AS (SELECT dim, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b, sum(r) FILTER (side = 'a') AS ra FROM rk GROUP BY 1)
SELECT dim, n_a, n_b, round(ra - n_a * (n_a + 1) / 2, 6) AS u FROM nn""")
def mann_whitney_u(spark, d):
    """The rank statistic."""
    return A.rounded(S.rank_sums(_sides(spark, d), ["dim"]).select("dim", "n_a", "n_b", "u"))


@query()
def mann_whitney_p(spark, d):
    """With p-values."""
    return A.rounded(S.mann_whitney(_sides(spark, d), ["dim"]))


@query("WITH " + A.SQL["long"] + """,
pv AS (SELECT dim, value, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM long GROUP BY ALL),
pc AS (SELECT dim, value, sum(a) OVER w / sum(a) OVER (PARTITION BY dim) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY dim) AS fb, lead(value) OVER (PARTITION BY dim ORDER BY value) AS nx FROM pv WINDOW w AS (PARTITION BY dim ORDER BY value))
SELECT dim, round(coalesce(sum(abs(fa - fb) * (nx - value)), 0), 6) AS w1 FROM pc GROUP BY 1""")
def wasserstein_1d(spark, d):
    """W16."""
    return A.rounded(S.wasserstein(_sides(spark, d), ["dim"]))


@query(A.sql("SELECT episode_id, " + ", ".join(f"round(({n} - avg({n}) OVER ()) / (stddev_pop({n}) OVER () + 1e-9), 6) AS {n}" for n in DIMS) + " FROM vfeat", "vfeat"))
def standardize(spark, d):
    """M1."""
    return A.rounded(M.standardized(K.velocity_features(A.velocity(spark, d)), DIMS))


@query()
def pca_projection(spark, d):
    """M1, M2, M6: two leading components of the features."""
    z = K.feature_matrix(K.velocity_features(A.velocity(spark, d)))
    model = M.fit_pca(z, 2)
    return z.select("episode_id", model.transform(F.col("z"), 4).alias("z"))


_N = len(FEATURES)
_PLANE = A.SQL["vfeat"] + f""",
pz AS (SELECT episode_id, unnest([{", ".join(f"{n}::DOUBLE" for n in sorted(FEATURES))}]) AS x, unnest(range({_N})) AS p FROM vfeat),
ps AS (SELECT p, avg(x) AS m, stddev_pop(x) + 1e-9 AS s FROM pz GROUP BY p), st AS (SELECT episode_id, p, (x - m) / s AS v FROM pz JOIN ps USING (p)),
gr AS (SELECT i, list(c ORDER BY j) AS r FROM (SELECT a.p AS i, b.p AS j, avg(a.v * b.v) AS c FROM st a JOIN st b USING (episode_id) GROUP BY ALL) GROUP BY i), gm AS (SELECT list(r ORDER BY i) AS g FROM gr),
e1(it, v) AS (SELECT 0, list_transform(range({_N}), lambda i: 1.0::DOUBLE + i / 10) UNION ALL SELECT it + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) FROM (SELECT it, list_transform(g, lambda r: list_inner_product(r, v)) AS w FROM e1, gm WHERE it < 600)),
c1 AS (SELECT v AS a, list_inner_product(v, list_transform(g, lambda r: list_inner_product(r, v))) AS l FROM e1, gm WHERE it = 600),
e2(it, v) AS (SELECT 0, list_transform(range({_N}), lambda i: 1.0::DOUBLE - i / 10) UNION ALL SELECT it + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) FROM
  (SELECT it, list_transform(g, lambda r, i: list_inner_product(r, v) - l * list_inner_product(a, v) * a[i]) AS w FROM e2, gm, c1 WHERE it < 600)),
dirs AS (SELECT 1 AS k, a AS v FROM c1 UNION ALL SELECT 2, v FROM e2 WHERE it = 600),
ld AS (SELECT k, unnest(v) AS w, unnest(range({_N})) AS p, sign(list_extract(v, list_position(list_transform(v, lambda x: abs(x)), list_max(list_transform(v, lambda x: abs(x)))))) AS s FROM dirs)"""


@query(f"WITH RECURSIVE {_PLANE}\nSELECT episode_id, round(sum(v * w * s) FILTER (k = 1), 4) AS x, round(sum(v * w * s) FILTER (k = 2), 4) AS y FROM st JOIN ld USING (p) GROUP BY episode_id")
def atlas_plane(spark, d):
    """M1, M2, M6: places in the plane of the two leading components."""
    z = settled(K.feature_matrix(K.velocity_features(A.velocity(spark, d))), "matrix")
    place = M.fit_pca(z, 2).transform(F.col("z"))
    return A.rounded(z.select("episode_id", place.alias("_p")).select("episode_id", F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y")), 4)


@query(f"WITH RECURSIVE {_PLANE}\nSELECT i, round(unnest(r), 6) + 0.0 AS r, unnest(range({_N})) AS j FROM gr")
def feature_correlations(spark, d):
    """M1: cross products of the standardised features."""
    n, s, g = M.moments(K.feature_matrix(K.velocity_features(A.velocity(spark, d))))
    mean = s / max(n, 1)
    cov = g / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
    return A.rounded(spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(cov / np.outer(spread, spread)) for j, x in enumerate(row)], "i long, j long, r double"))


@query()
def shape_encoding(spark, d):
    """M3: representation B."""
    enc = M.Encoder("shape", K.shape_series).fit(A.samples(spark, d), 8)
    return enc.encode(A.samples(spark, d)).select("episode_id", F.transform("z", lambda x: F.round(x, 6)).alias("z"))


@query()
def motif_clusters(spark, d):
    """K-means motifs and their share in each label."""
    z = settled(K.feature_matrix(labelled_features(spark, d), "label"), "matrix")
    centre, _ = M.kmeans(z, 6)
    return A.rounded(M.occupancy(M.assign(z, M.centre_table(spark, centre))))
