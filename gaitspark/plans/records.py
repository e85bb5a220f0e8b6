"""Queries of records, scans, ground truth and stored forms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import to_uint8
from ..functions.labels import clip_kind, effective_label, interaction_label, is_reviewed, provenance_text, shamble_label, trajectory_usable
from ..operators import atlas as AT
from ..operators import kinematics as K
from ..operators import labels as L
from ..operators import retrieval as R
from ..operators import tracking as T
from ..schema import BIO_LABELS, FEATURES, REJECTED_STATES
from ..session import settled, shared_path
from ..sources import files
from . import adapters as A
from .motion import _EFF, annotated
from .scenes import _ALL, _EU, detections

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# --- labels -----------------------------------------------------------------------

_TODO = "coalesce(annotation_status, 'unreviewed') = 'unreviewed'"


@query(A.sql(f"SELECT episode_id, annotation_status FROM annotated WHERE {_TODO} OR NOT (SELECT bool_or({_TODO}) FROM annotated)", "annotated"))
def review_queue(spark, d):
    """What a review session asks for next."""
    _, queue = L.session_state(annotated(spark, d).drop("annotation_status").withColumn("annotation_status", F.lit(None).cast("string")), A.annotations(spark, d))
    return queue.select("episode_id", "annotation_status")


@query(A.sql(f"SELECT s AS label, count(episode_id) AS n FROM (SELECT unnest({list(BIO_LABELS)}) AS s) LEFT JOIN annotated ON {_EFF} = s GROUP BY s", "annotated"))
def label_counts(spark, d):
    """A8, K5."""
    return L.label_counts(annotated(spark, d))


@query(A.sql(f"""SELECT 'status' AS kind, CASE WHEN ok THEN 'kept' ELSE 'rejected' END AS name, count(*) AS n FROM okd GROUP BY 2 UNION ALL SELECT 'taxon', taxon, count(*) FROM okd WHERE ok GROUP BY 2""", "annotated").replace("\nSELECT 'status'", f",\nokd AS (SELECT {_EFF} AS taxon, annotation_status NOT IN {REJECTED_STATES} AND duration_s >= 100 AS ok FROM annotated)\nSELECT 'status'", 1))
def index_metadata(spark, d):
    """A26."""
    return R.index_metadata(annotated(spark, d).withColumn("taxon", effective_label()), L.accepts(F.col("duration_s"), min_duration=100))


@query(A.sql(f"""SELECT episode_id, annotation_status <> 'unreviewed' AS reviewed, coalesce(nullif(human_label, ''), 'unannotated') AS human, CASE WHEN nullif(human_label, '') IS NULL THEN 'unannotated' ELSE {_EFF} END AS required FROM annotated""", "annotated"))
def interaction_labels(spark, d):
    """P12, P24."""
    return annotated(spark, d).select("episode_id", is_reviewed(F.col("annotation_status")).alias("reviewed"), interaction_label(human_only=True).alias("human"), interaction_label(required=True).alias("required"))


@query(A.sql("""SELECT episode_id, count(*)::DOUBLE / (max(frame) - min(frame) + 1) >= 0.5 AND NOT max(gap) > 100 AS usable FROM (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY episode_id ORDER BY frame), 0) AS gap FROM trk) GROUP BY 1""", "trk"))
def usable_tracks(spark, d):
    """P7."""
    s = A.samples(spark, d).withColumn("gap", F.coalesce(F.col("frame") - F.lag("frame").over(K.episode().orderBy("frame")), F.lit(0)))
    g = s.groupBy("episode_id").agg((F.count("*") / (F.max("frame") - F.min("frame") + 1)).alias("coverage"), F.max("gap").alias("gap"))
    return g.select("episode_id", trajectory_usable(F.col("coverage"), F.when(F.col("gap") > 100, F.array(F.lit("large_gaps")))).alias("usable"))


@query("""SELECT split, item FROM (SELECT unnest(splits) AS split, item FROM (SELECT item, list(DISTINCT split) AS splits FROM (SELECT c_nationkey AS item, CASE WHEN c_custkey % 40 < 20 THEN 'train' ELSE 'holdout' END AS split FROM customer) GROUP BY item HAVING count(DISTINCT split) > 1))""")
def overlapping_splits(spark, d):
    """U4."""
    c = A.read(spark, d, "customer").select(F.col("c_nationkey").alias("item"), F.when(F.col("c_custkey") % 40 < 20, "train").otherwise("holdout").alias("split"))
    return L.overlapping_splits(c).select(F.explode("splits").alias("split"), "item")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ant' WHEN 1 THEN 'mimic' WHEN 2 THEN 'other_spider' END AS label, CASE WHEN c_custkey % 3 = 0 THEN 'video' WHEN c_custkey % 2 > 0 THEN 'traj_replay' ELSE 'gait_replay' END AS kind,
greatest(0, least(255, trunc(c_acctbal * 0.1)))::INT AS grey, 'scan m' || (c_custkey % 5) || ' 1 -> track t 2' AS history FROM customer""")
def imported_rows(spark, d):
    """P16, P18, P21, P23."""
    c = A.read(spark, d, "customer")
    name = F.element_at(F.array(*[F.lit(x) for x in ("ANT Lasius", "Myrmarachne formicaria", "Salticus senicus", "1.3cm ball")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    step = lambda *v: F.struct(*[x.alias(n) for n, x in zip(("step", "model", "version"), v, strict=True)])
    history = F.array(step(F.lit("scan"), F.concat(F.lit("m"), (F.col("c_custkey") % 5).cast("string")), F.lit("1")), step(F.lit("track"), F.lit("t"), F.lit("2")))
    return c.select("c_custkey", shamble_label(name).alias("label"), clip_kind(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 2).alias("kind"), to_uint8(F.col("c_acctbal").cast("double"), 0.1).alias("grey"), provenance_text(history).alias("history"))


# --- tracks -----------------------------------------------------------------------


@query(A.sql("""SELECT episode_id, frame, round(x - sum(CASE WHEN s >= 0.3 AND s <= 120 THEN dx ELSE 0 END) OVER w, 6) AS x, round(y - sum(CASE WHEN s >= 0.3 AND s <= 120 THEN dy ELSE 0 END) OVER w, 6) AS y FROM
(SELECT *, x / 50 - 1 AS dx, y / 10 AS dy, sqrt((x / 50 - 1) * (x / 50 - 1) + (y / 10) * (y / 10)) AS s FROM trk) WINDOW w AS (PARTITION BY episode_id ORDER BY frame)""", "trk"))
def stabilized(spark, d):
    """P22."""
    s = A.samples(spark, d).select(F.col("episode_id").alias("video_id"), "frame", "x", "y")
    moved = T.stabilized(s, s.select("video_id", "frame", (F.col("x") / 50 - 1).alias("dx"), (F.col("y") / 10).alias("dy")))
    return A.rounded(moved.select(F.col("video_id").alias("episode_id"), "frame", "x", "y"))


@query(A.sql("SELECT episode_id, (rn - 1)::INT AS pos, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY frame) AS rn FROM trk) WHERE rn <= 400", "trk"))
def trail(spark, d):
    """L3."""
    t = AT.trail(A.samples(spark, d)).select("episode_id", F.posexplode("points").alias("pos", "p"))
    return A.rounded(t.select("episode_id", "pos", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")))


@query(A.sql("SELECT episode_id, round(sqrt((x - 100) * (x - 100) + (y - 50) * (y - 50)), 6) AS d FROM (SELECT episode_id, avg(x) AS x, avg(y) AS y FROM trk GROUP BY 1) WHERE sqrt((x - 100) * (x - 100) + (y - 50) * (y - 50)) <= 90 ORDER BY sqrt((x - 100) * (x - 100) + (y - 50) * (y - 50)), episode_id LIMIT 50", "trk"))
def region(spark, d):
    """The 50 nearest within 90 px."""
    p = A.samples(spark, d).groupBy("episode_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return A.rounded(AT.region(p, (100.0, 50.0)).select("episode_id", "d"))


@query(A.sql("SELECT episode_id, median(d)::DOUBLE AS step FROM (SELECT episode_id, frame - lag(frame) OVER (PARTITION BY episode_id ORDER BY frame) AS d FROM trk) WHERE d > 0 GROUP BY 1 UNION ALL SELECT episode_id, 1.0 FROM trk GROUP BY 1 HAVING count(*) = 1", "trk"))
def median_step(spark, d):
    """W20."""
    return K.median_step(A.samples(spark, d))


@query(A.sql("""SELECT episode_id, i, round(v, 4) AS speed, 0.0::DOUBLE AS turn, CASE WHEN v > 0.1 * greatest(med, 1e-9) THEN 1.0 ELSE 0.0 END::DOUBLE AS moving FROM (SELECT *, count(*) OVER (PARTITION BY episode_id) AS n, median(v) OVER (PARTITION BY episode_id) AS med FROM vel)
WHERE n <= 160 OR i IN (SELECT unnest(list_transform(range(160), lambda j: (j * (n - 1)) // 159)))""", "vel"))
def scalar_series(spark, d):
    """W13."""
    return A.rounded(K.scalar_series(A.velocity(spark, d)), 4)


@query(A.sql("SELECT episode_id, (p - 1)::INT AS pos, round([" + ", ".join(f"coalesce({f}, 0)" for f in FEATURES) + "][p] + 1e-9, 6)::DOUBLE AS value FROM vfeat, range(1, 17) r(p)", "vfeat"))
def feature_matrix(spark, d):
    """A3."""
    m = K.feature_matrix(K.velocity_features(A.velocity(spark, d)))
    return A.rounded(m.select("episode_id", F.posexplode("z").alias("pos", "value")), nudge=1e-9)


@query(A.sql("SELECT episode_id, frame, round(x * cos(0.7) - y * sin(0.7) + 40, 6) AS x, round(x * sin(0.7) + y * cos(0.7) - 25, 6) AS y FROM trk", "trk"))
def augmented(spark, d):
    """M7."""
    return A.rounded(K.translate(K.rotate(A.samples(spark, d), 0.7), 40.0, -25.0).select("episode_id", "frame", "x", "y"))


_HALF = f"ah AS (SELECT a.id AS query_id, b.id AS id, {_EU.format(a='a.z[1:32]', b='b.z[1:32]')} AS dist FROM vec a, vec b WHERE a.id <> b.id)"
_TOP8 = "SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM {}) WHERE rank <= 8"


@query(f"WITH {_ALL},\n{_HALF},\nka AS ({_TOP8.format('ad')}), kh AS ({_TOP8.format('ah')})\nSELECT ka.query_id, count(kh.id) / 8 AS consistency FROM ka LEFT JOIN kh ON kh.query_id = ka.query_id AND kh.id = ka.id GROUP BY 1")
def kept_share(spark, d):
    """Neighbours that stay if vectors lose their second half."""
    v = settled(A.vectors(spark, d).select("id", "z"), "vectors")
    return R.kept_share(R.all_knn(v), R.all_knn(v.withColumn("z", F.slice("z", 1, 32))), 8)


@query(A.sql("SELECT e.episode_id, coalesce(CASE WHEN e.episode_id % 3 > 0 THEN 'own ' || e.episode_id END, CASE WHEN e.episode_id % 2 = 0 THEN 'reference ' || e.episode_id END) AS meta FROM (SELECT DISTINCT episode_id FROM trk) e", "trk"))
def fallback_meta(spark, d):
    """J16."""
    e = A.samples(spark, d).select("episode_id").distinct()
    named = lambda word, keep: e.where(keep).select("episode_id", F.concat(F.lit(word), F.col("episode_id").cast("string")).alias("meta"))
    return AT.with_fallback(e, named("own ", F.col("episode_id") % 3 > 0), named("reference ", F.col("episode_id") % 2 == 0))


# --- detections and truth ---------------------------------------------------------------


@query(A.sql("SELECT event_id, video_id, frame, round(x1 - 60, 6) AS x1, round(y1 - 5, 6) AS y1 FROM det WHERE frame % 3 = 0 AND frame <= 80 AND (x1 + x2) / 2 >= 60 AND (x1 + x2) / 2 < 160 AND (y1 + y2) / 2 >= 5 AND (y1 + y2) / 2 < 75", "det"))
def scanned_detections(spark, d):
    """About ten frames a second of thirty, a region and a last frame."""
    rows = T.scan_detections(detections(spark, d), T.frame_skip(30.0, 10.0), (60.0, 5.0, 100.0, 70.0), 80)
    return A.rounded(rows.select("event_id", "video_id", "frame", "x1", "y1"))


_SIDE = lambda a: f"(greatest(least({a}.x2, b.x2) - greatest({a}.x1, b.x1), 0) * greatest(least({a}.y2, b.y2) - greatest({a}.y1, b.y1), 0))"
_IOU = f"{_SIDE('k')} / greatest((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_SIDE('k')}, 1e-9)"


@query("WITH RECURSIVE " + A.SQL["det"] + f""",
nb AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY confidence DESC, x1, y1, x2, y2) AS nth, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS b FROM det),
go AS (SELECT video_id, frame, nth, [b] AS kept, true AS stays FROM nb WHERE nth = 1
 UNION ALL SELECT g.video_id, g.frame, n.nth, CASE WHEN len(list_filter(g.kept, lambda k: {_IOU.replace('b.', 'n.b.')} >= 0.45)) = 0 THEN list_append(g.kept, n.b) ELSE g.kept END, len(list_filter(g.kept, lambda k: {_IOU.replace('b.', 'n.b.')} >= 0.45)) = 0
 FROM go g JOIN nb n ON n.video_id = g.video_id AND n.frame = g.frame AND n.nth = g.nth + 1)
SELECT nb.video_id, nb.frame, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(confidence, 6) AS confidence FROM nb JOIN go ON go.video_id = nb.video_id AND go.frame = nb.frame AND go.nth = nb.nth WHERE stays""")
def suppressed(spark, d):
    """Greedy suppression."""
    return A.rounded(T.nms(detections(spark, d)).drop("cls"))


_EMA = [(0.6, 1 - 0.6), (0.25, 1 - 0.25), (0.08, 1 - 0.08)]


@query("WITH RECURSIVE " + A.SQL["vel"] + """,
em AS (SELECT episode_id, i, v, 0.0::DOUBLE AS e0, 0.0::DOUBLE AS e1, 0.0::DOUBLE AS e2 FROM vel WHERE i = 0
 UNION ALL SELECT n.episode_id, n.i, n.v, """ + ", ".join(f"{rest!r}::DOUBLE * e{k} + {a!r}::DOUBLE * coalesce(abs(n.v - em.v), 0)" for k, (a, rest) in enumerate(_EMA)) + """ FROM em JOIN vel n ON n.episode_id = em.episode_id AND n.i = em.i + 1)
SELECT episode_id, i::INT AS i, """ + ", ".join(f"floor(greatest(0, least(255, e{k})))::INT AS c{k}" for k in range(3)) + " FROM em")
def motion_averages(spark, d):
    """T-5, T-12: decaying averages of changes."""
    s = A.velocity(spark, d).groupBy("episode_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("s"))
    return s.select("episode_id", F.posexplode(T.motion_colour(F.col("s"))).alias("i", "c")).select("episode_id", "i", "c.*")


def _points(spark, d):
    """Tracks of the samples, a fifth of their points filled in."""
    s = A.samples(spark, d)
    f, e = F.col("frame"), F.col("episode_id")
    return s.select(
        F.col("scene").alias("video_id"), e.alias("track"), "frame", "x", "y", F.lit(8.0).alias("w"), F.lit(6.0).alias("h"), ((f * 7 + e) % 100 / 100.0).alias("confidence"), ((f * 3 + e) % 50 / 50.0).alias("association"),
        F.when(f % 5 == 0, "interpolated").otherwise("observed").alias("state"), F.when(e % 4 == 0, "merge").otherwise("gap").alias("ended"),
    )


A.SQL["pnt"] = A.SQL["trk"] + ",\npnt AS (SELECT scene AS video_id, episode_id AS track, frame, x, y, ((frame * 7 + episode_id) % 100 / 100.0)::DOUBLE AS confidence, ((frame * 3 + episode_id) % 50 / 50.0)::DOUBLE AS association, frame % 5 <> 0 AS seen, CASE WHEN episode_id % 4 = 0 THEN 'merge' ELSE 'gap' END AS ended FROM trk)"
A.SQL["eps"] = A.SQL["pnt"] + """,
ep0 AS (SELECT video_id, track, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n, count(*) FILTER (seen) AS observed, avg(confidence) FILTER (seen) AS mean_confidence, avg(association) AS tracking_confidence, any_value(ended) AS ended FROM pnt GROUP BY ALL),
eps AS (SELECT *, (end_frame - start_frame)::DOUBLE AS duration_s, n / (end_frame - start_frame + 1) AS coverage, 1 - observed / n AS filled FROM ep0 WHERE observed >= 2 AND end_frame - start_frame BETWEEN 100 AND 700 AND 1 - observed / n <= 0.5)"""


@query(A.sql("""SELECT video_id, track, n, observed, round(duration_s + 1e-9, 6) AS duration_s, round(coverage + 1e-9, 6) AS coverage, round(filled + 1e-9, 6) AS filled, round(mean_confidence + 1e-9, 6) AS mean_confidence, round(tracking_confidence + 1e-9, 6) AS tracking_confidence,
array_to_string(list_filter([CASE WHEN coverage < 0.9 THEN 'gaps' END, CASE WHEN round(mean_confidence, 9) < 0.5 THEN 'faint' END, CASE WHEN ended = 'merge' THEN 'ended_by_merge' END], lambda x: x IS NOT NULL), ',') AS flags, 'ep_' || substr(sha256(video_id || '|' || track || '|' || start_frame), 1, 12) AS episode_id FROM eps""", "eps"))
def episodes_of_tracks(spark, d):
    """P8, P9, A32."""
    e = T.episodes_of(_points(spark, d), 1.0, 100.0, 700.0)
    return A.rounded(e.select("video_id", "track", "n", "observed", "duration_s", "coverage", "filled", "mean_confidence", "tracking_confidence", F.array_join("flags", ",").alias("flags"), "episode_id"), nudge=1e-9)


@query(A.sql("SELECT video_id, count(*) AS tracks, list_sort(list(n))[count(*) // 2 + 1] AS median_length FROM (SELECT video_id, track, count(*) AS n FROM pnt GROUP BY ALL) GROUP BY 1", "pnt"))
def run_stats(spark, d):
    """A31."""
    return T.run_stats(_points(spark, d))


@query(A.sql("""SELECT video_id, frames, with_dets, episodes, CASE WHEN why IS NULL THEN 'ok' ELSE 'failed' END AS status, why AS reason FROM
(SELECT *, CASE WHEN frames >= 10 AND with_dets / frames < 0.02 THEN 'no detections' WHEN mean_conf < 0.2 THEN 'faint detections' WHEN frames >= 100 AND episodes = 0 THEN 'no episodes' END AS why FROM
(SELECT f.video_id, frames, coalesce(with_dets, 0) AS with_dets, mean_conf, coalesce(episodes, 0) AS episodes FROM (SELECT scene AS video_id, count(DISTINCT frame) AS frames FROM trk GROUP BY 1) f
LEFT JOIN (SELECT video_id, count(DISTINCT frame) AS with_dets, avg(confidence) AS mean_conf FROM pnt WHERE frame % 5 <> 0 AND video_id <> '3@1' GROUP BY 1) g USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS episodes FROM eps WHERE track % 10 <> 4 GROUP BY 1) e USING (video_id)))""", "eps"))
def quality_gate(spark, d):
    """P10: one video without detections, one without episodes."""
    p = _points(spark, d)
    episodes = T.episodes_of(p, 1.0, 100.0, 700.0).where("track % 10 <> 4")
    out = T.quality_gate(p.select("video_id", "frame"), p.where("state = 'observed' and video_id <> '3@1'"), episodes, 1.0, 100.0)
    return out.select("video_id", "frames", "with_dets", "episodes", "status", "reason")


_TRUTH = A.SQL["trk"] + """,
wp AS (SELECT scene, episode_id::VARCHAR AS animal, frame::DOUBLE AS t, x, y, lead(frame::DOUBLE) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w = 1 AS is_first FROM trk WINDOW w AS (PARTITION BY episode_id ORDER BY frame)),
tp AS (SELECT scene, animal, f AS frame, x + coalesce(greatest(0, (f - t) / greatest(t1 - t, 1e-9)), 0) * (coalesce(x1, x) - x) AS x, y + coalesce(greatest(0, (f - t) / greatest(t1 - t, 1e-9)), 0) * (coalesce(y1, y) - y) AS y
  FROM wp, range(720) r(f) WHERE f >= CASE WHEN is_first THEN 0 ELSE t END AND (t1 IS NULL OR f < t1))"""


def _truth(spark, d):
    s = A.samples(spark, d)
    way = s.select("scene", F.col("episode_id").cast("string").alias("animal"), F.col("frame").cast("double").alias("t_s"), "x", "y")
    return T.truth_points(way, spark.createDataFrame([], "scene string, animal string, t0_s double, t1_s double"), 1.0, 720.0)


@query(f"WITH {_TRUTH}\nSELECT scene, animal, frame, round(x + 1e-9, 6) AS x, round(y + 1e-9, 6) AS y FROM tp")
def truth_points(spark, d):
    """Places between samples, by the hour."""
    return A.rounded(_truth(spark, d), nudge=1e-9)


_MATCH = _TRUTH + """,
mt AS (SELECT p.scene, p.track, p.frame, min({'d': sqrt((p.x - tp.x) * (p.x - tp.x) + (p.y - tp.y) * (p.y - tp.y)), 'animal': tp.animal}) AS m FROM (SELECT scene, episode_id AS track, frame, x + 1 AS x, y + 2 AS y FROM trk) p JOIN tp ON tp.scene = p.scene AND tp.frame = p.frame GROUP BY ALL),
vt AS (SELECT scene, track, m.animal AS animal, count(*) AS n, avg(m.d) AS error FROM mt GROUP BY ALL),
bt AS (SELECT *, row_number() OVER (PARTITION BY scene, track ORDER BY n DESC, error) AS rn, sum(n) OVER (PARTITION BY scene, track) AS total FROM vt),
mm AS (SELECT scene, track, animal, n / total AS purity, error FROM bt WHERE rn = 1)"""


def _matched(spark, d):
    p = A.samples(spark, d).select("scene", F.col("episode_id").alias("track"), "frame", (F.col("x") + 1).alias("x"), (F.col("y") + 2).alias("y"))
    return T.match_truth(p, _truth(spark, d))


@query(f"WITH {_MATCH}\nSELECT scene, track, round(purity, 6) AS purity, round(error, 6) AS error FROM mm")
def matched_truth(spark, d):
    """J11, A29."""
    return A.rounded(_matched(spark, d).select("scene", "track", "purity", "error"))


@query(f"""WITH {_MATCH},
sc AS (SELECT scene, count(DISTINCT animal) AS animals, count(*)::DOUBLE AS moved_s FROM tp GROUP BY 1),
du AS (SELECT scene, episode_id AS track, (max(frame) - min(frame))::DOUBLE AS duration_s FROM trk GROUP BY ALL),
pe AS (SELECT scene, count(*) AS n, count(*) FILTER (purity < 0.9) AS mixed, sum(CASE WHEN purity >= 0.95 THEN duration_s ELSE 0 END) AS usable_s FROM mm JOIN du USING (scene, track) GROUP BY 1),
al AS (SELECT sum(coalesce(mixed, 0)) / greatest(sum(coalesce(n, 0)), 1) AS fm, avg(greatest(coalesce(n, 0) - animals, 0)) AS fr, sum(coalesce(usable_s, 0)) / greatest(sum(moved_s), 1e-9) AS re FROM sc LEFT JOIN pe USING (scene))
SELECT round(fm, 6) AS false_merge_rate, round(fr, 6) AS fragmentation, round(re, 6) AS recall, round(5 * fm + 0.5 * fr + (1 - re), 6) AS cost FROM al""")
def benchmark_cost(spark, d):
    """A30."""
    spans = A.samples(spark, d).groupBy("scene", F.col("episode_id").alias("track")).agg((F.max("frame") - F.min("frame")).cast("double").alias("duration_s"))
    return A.rounded(T.benchmark_cost(_matched(spark, d), _truth(spark, d), spans, 1.0))


# --- stored forms: what is written is read again -----------------------------------------


@query(A.sql("SELECT episode_id::VARCHAR AS episode_id, human_label, qc_state FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seq DESC) AS rn FROM ann) WHERE rn = 1", "ann"))
def stored_annotations(spark, d):
    """K3, K4, S2, T-8: a log that is appended to twice, then replayed."""
    path = shared_path(spark, "log")
    log = A.annotations(spark, d).withColumn("episode_id", F.col("episode_id").cast("string"))
    files.append_annotations(log.where("seq <= 20"), path)
    files.append_annotations(log.where("seq > 20"), path)
    return L.latest_annotations(files.read_annotation_log(spark, path)).select("episode_id", "human_label", "qc_state")


@query("""SELECT episode_id::VARCHAR AS episode_id, human_label, qc_state, place - 1 AS seq FROM (SELECT *, row_number() OVER (ORDER BY batch % 3, user_id, event_id) AS place, row_number() OVER (PARTITION BY episode_id ORDER BY batch % 3 DESC, event_id DESC) AS rn FROM
(SELECT user_id AS episode_id, user_id, event_id, event_id % 7 AS batch, CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'unreviewed' WHEN 'purchase' THEN 'rejected' WHEN 'signup' THEN 'edge_effect' ELSE 'too_short' END AS qc_state,
CASE WHEN event_id % 2 = 0 THEN 'ant' ELSE 'siler' END AS human_label FROM events)) WHERE rn = 1""")
def replayed_appends(spark, d):
    """Three appends without seq, in the order of their rows; the last record of an episode wins, and says where it stands in the log."""
    path = shared_path(spark, "appends")
    e = A.annotation_states(A.read(spark, d, "events"))
    for k in (0, 1, 2):
        rows = e.where(F.col("event_id") % 7 % 3 == k).repartitionByRange("user_id", "event_id").sortWithinPartitions("user_id", "event_id")
        label = F.when(F.col("event_id") % 2 == 0, "ant").otherwise("siler")
        files.append_annotations(rows.select(F.col("user_id").cast("string").alias("episode_id"), label.alias("human_label"), F.lit(1.0).alias("human_confidence"), "qc_state"), path)
    last = files.read_annotation_log(spark, path).groupBy("episode_id").agg(F.max_by(F.struct("human_label", "qc_state", "seq"), "seq").alias("r"))
    return last.select("episode_id", "r.*")


@query(A.sql("SELECT episode_id::VARCHAR AS episode_id, CASE WHEN episode_id % 2 = 0 THEN label END AS human_label, CASE WHEN episode_id % 2 > 0 THEN label END AS machine_label, CASE WHEN episode_id % 2 = 0 THEN 'accepted' ELSE 'unreviewed' END AS annotation_status, n FROM (SELECT episode_id, label, count(*) AS n FROM trk GROUP BY ALL)", "trk"))
def stored_episodes(spark, d):
    """First-version episodes, written as JSON lines and migrated when read."""
    path = shared_path(spark, "episodes")
    s = A.samples(spark, d).groupBy("episode_id", "label").agg(F.sort_array(F.collect_list("frame")).alias("frames"))
    source = F.when(F.col("episode_id") % 2 == 0, "human:x").otherwise("model:y")
    files.write_episodes(s.select(F.col("episode_id").cast("string").alias("episode_id"), F.col("label").alias("bio_label"), source.alias("bio_label_source"), "frames"), path)
    return files.read_episodes(spark, path).select("episode_id", "human_label", "machine_label", "annotation_status", F.size("frames").cast("long").alias("n"))


@query(A.sql("SELECT id, taxon, '2' AS version_id FROM vec WHERE id % 3 > 0", "vec"))
def stored_index(spark, d):
    """Two versions, of which the newest is read."""
    path = shared_path(spark, "index")
    v = A.vectors(spark, d).select("id", "taxon")
    files.save_index(v, path, "1")
    files.save_index(v.where("id % 3 > 0"), path, "2")
    return files.newest_version(spark, path).select("id", "taxon", "version_id")


@query(A.sql("SELECT 'r' || (id % 2) AS run_id, count(*) AS n FROM vec GROUP BY 1", "vec"))
def stored_runs(spark, d):
    """Two runs with a manifest, each in its own partition."""
    root = shared_path(spark, "runs")
    v = A.vectors(spark, d).select("id")
    for r in (0, 1):
        files.append_runs(v.where(F.col("id") % 2 == r), files.new_run(spark, root, f"r{r}", "m", "1", {"r": r}), f"r{r}")
    known = spark.read.parquet(f"{root}/manifest").select("run_id")
    return spark.read.parquet(f"{root}/runs").join(known, "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("n"))
