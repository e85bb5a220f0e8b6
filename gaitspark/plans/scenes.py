"""Queries of interaction, retrieval, tracking and the atlas."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import circular_mean_deg
from ..functions.labels import confidence_band, normalize_class, recalibrated_confidence, similarity_level
from ..operators import atlas as AT
from ..operators import interaction as I
from ..operators import kinematics as K
from ..operators import models as M
from ..operators import retrieval as R
from ..operators import tracking as T
from ..operators.segments import track_segments
from ..session import settled
from . import adapters as A
from .motion import DIMS, GROUPS, labelled_features

QUERIES: dict = {}
ORACLES: dict = {}
RADII = [20.0, 40.0, 80.0]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PG = """
SELECT scene, focal, neighbor, any_value(focal_label) AS focal_label, any_value(neighbor_label) AS neighbor_label, count(*) AS n_frames, round(min(distance), 6) AS min_distance, round(avg(distance), 6) AS mean_distance, round(max(distance), 6) AS max_distance,
  round(arg_min(frame, (distance, frame)), 6)::DOUBLE AS t_min_s, round(avg(hdiff), 6) AS mean_heading_diff, round(avg(cos(radians(hdiff))), 6) AS mean_alignment, round(avg(closing), 6) AS closing_rate, round(avg(focal_speed), 6) AS focal_speed, round(avg(neighbor_speed), 6) AS neighbor_speed,
  round(avg(CASE WHEN hdiff <= 60 THEN 1.0 WHEN hdiff IS NOT NULL THEN 0.0 END), 6)::DOUBLE AS front, round(avg(CASE WHEN hdiff > 60 AND hdiff <= 120 THEN 1.0 WHEN hdiff IS NOT NULL THEN 0.0 END), 6)::DOUBLE AS side, round(avg(CASE WHEN hdiff > 120 THEN 1.0 WHEN hdiff IS NOT NULL THEN 0.0 END), 6)::DOUBLE AS rear
FROM (SELECT *, -(distance - lag(distance) OVER w) / (frame - lag(frame) OVER w) AS closing FROM pairs WINDOW w AS (PARTITION BY scene, focal, neighbor ORDER BY frame)) GROUP BY scene, focal, neighbor HAVING count(*) >= 3"""


@query(A.sql(_PG, "pairs"))
def pair_geometry(spark, d):
    """A12, J1, W9."""
    return I.pair_geometry(A.samples(spark, d), digits=6)


_CTX = "SELECT scene, focal, radius, label, n_frames, round(nearest_mean, 6) AS nearest_mean, round(nearest_ant_min, 6) AS nearest_ant_min, round(mean_near, 6) AS mean_near, max_ants, round(mean_ants, 6) AS mean_ants, round(ant_speed, 6) AS ant_speed, round(ant_share, 6) AS ant_share, has_ant FROM ctx"


@query(A.sql(_CTX, "ctx"))
def neighbor_context(spark, d):
    """A13, J4, A20."""
    return A.rounded(I.neighbor_context(A.samples(spark, d), RADII).drop("ant_heading"))


@query(A.sql("SELECT episode_id, round(((degrees(atan2(avg(sin(heading)), avg(cos(heading)))) % 360) + 360) % 360, 4) AS heading_deg FROM sph WHERE heading IS NOT NULL GROUP BY 1", "sph"))
def circular_heading(spark, d):
    """A14."""
    h = K.frame_speed_heading(A.samples(spark, d)).where("heading is not null")
    return A.rounded(h.groupBy("episode_id").agg(circular_mean_deg(F.degrees("heading")).alias("heading_deg")), 4)


@query(A.sql("""SELECT s.scene, k AS "window", f0 + k * 12 AS start_frame, f0 + k * 12 + 24 AS end_frame, count(*) AS count, array_to_string(list_sort(list(episode_id)), ',') AS episode_ids
FROM (SELECT scene, min(frame) AS f0, max(frame) AS f1 FROM trk GROUP BY 1) s, LATERAL (SELECT unnest(range(greatest(0, ceil((f1 - f0 - 24) / 12.0))::BIGINT + 1)) AS k) w
JOIN (SELECT scene, episode_id, min(frame) AS a, max(frame) AS b FROM trk GROUP BY ALL) e ON e.scene = s.scene AND e.a <= f0 + k * 12 + 24 AND e.b >= f0 + k * 12 GROUP BY s.scene, k, f0""", "trk"))
def scene_windows(spark, d):
    """W11, J3, A15, with windows of 24 hours every 12."""
    return I.scene_windows(A.spans(spark, d), 24, 12).withColumn("episode_ids", F.array_join(F.transform("episode_ids", lambda x: x.cast("string")), ",")).drop("taxon_counts")


@query(A.sql("""SELECT s.scene, k AS "window", label, count(*) AS n
FROM (SELECT scene, min(frame) AS f0, max(frame) AS f1 FROM trk GROUP BY 1) s, LATERAL (SELECT unnest(range(greatest(0, ceil((f1 - f0 - 24) / 12.0))::BIGINT + 1)) AS k) w
JOIN (SELECT scene, episode_id, label, min(frame) AS a, max(frame) AS b FROM trk GROUP BY ALL) e ON e.scene = s.scene AND e.a <= f0 + k * 12 + 24 AND e.b >= f0 + k * 12 GROUP BY s.scene, k, label""", "trk"))
def scene_window_taxa(spark, d):
    """Counts of taxa."""
    return I.scene_windows(A.spans(spark, d), 24, 12).select("scene", "window", F.explode("taxon_counts").alias("label", "n"))


_DANT = " + ".join(f"abs(({n} - am_{n}) / (s_{n} + 1e-9)) / greatest(as_{n} / (s_{n} + 1e-9), 1e-9)" for n in DIMS)
A.SQL["dant"] = A.SQL["lf"] + ",\nmm AS (SELECT count(*) AS n, count(*) FILTER (label = 'ant') AS n_ant, " + ", ".join(f"stddev_pop({n}) AS s_{n}, avg({n}) FILTER (label = 'ant') AS am_{n}, stddev_pop({n}) FILTER (label = 'ant') AS as_{n}" for n in DIMS) + f" FROM lf),\ndant AS (SELECT episode_id, label, CASE WHEN n >= 5 AND n_ant >= 3 THEN ({_DANT}) / {len(DIMS)} END AS d_ant FROM lf, mm)"


@query(A.sql("SELECT episode_id, label, round(d_ant, 6) AS d_ant FROM dant", "dant"))
def d_ant(spark, d):
    """A16."""
    return A.rounded(I.d_ant(labelled_features(spark, d), DIMS))


_ANT = """,
cl AS (SELECT c.radius, c.focal AS episode_id, CASE WHEN ant_share >= 0.1 THEN 'a' ELSE 'b' END AS side, u.metric, u.value FROM ctx c JOIN dant USING (label) JOIN lf f ON f.episode_id = c.focal, LATERAL (SELECT * FROM (VALUES ('speed_mean', f.speed_mean), ('frac_time_moving', f.frac_time_moving)) t(metric, value)) u WHERE c.label IN ('siler', 'other_spider') AND dant.episode_id = c.focal)
SELECT radius, metric, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b, round(quantile_cont(value, 0.5) FILTER (side = 'a'), 6) AS median_a, round(quantile_cont(value, 0.5) FILTER (side = 'b'), 6) AS median_b FROM cl GROUP BY ALL HAVING count(*) FILTER (side = 'a') >= 3 AND count(*) FILTER (side = 'b') >= 3"""


@query("WITH " + A.SQL["ctx"] + ",\n" + A.SQL["dant"] + _ANT)
def distance_response(spark, d):
    """Medians with and without ants near in a tenth of the frames, at each radius."""
    context = I.neighbor_context(A.samples(spark, d), RADII, 0.1)
    out = I.ant_contrast(context, labelled_features(spark, d).select("episode_id", "speed_mean", "frac_time_moving"), ("speed_mean", "frac_time_moving"), ("siler", "other_spider"), 50)
    return A.rounded(out.select("radius", "metric", "n_a", "n_b", "median_a", "median_b"))


@query()
def distance_response_null(spark, d):
    """With the permutation envelope."""
    context = I.neighbor_context(A.samples(spark, d), RADII, 0.1)
    return A.rounded(I.ant_contrast(context, labelled_features(spark, d).select("episode_id", *DIMS), DIMS, ("siler", "other_spider")))


@query(A.sql("""SELECT scene, focal, neighbor, n_frames, round(mean_distance, 6) AS mean_distance, label, row_number() OVER (PARTITION BY scene, focal ORDER BY mean_distance, neighbor)::INT AS rank
FROM (SELECT scene, focal, neighbor, count(*) AS n_frames, avg(distance) AS mean_distance, any_value(neighbor_label) AS label FROM pairs GROUP BY scene, focal, neighbor HAVING count(*) >= 5)""", "pairs"))
def scene_neighbors(spark, d):
    """J13."""
    return I.scene_neighbors(A.samples(spark, d), 5, digits=6)


# --- retrieval --------------------------------------------------------------------

_Q = A.SQL["vec"] + ",\nq AS (SELECT * FROM vec WHERE id % 50 = 0), ix AS (SELECT * FROM vec)"
_EU = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
_COS = f"1 - {_DOT.format(a='q.z', b='ix.z')} / greatest(sqrt({_DOT.format(a='q.z', b='q.z')}) * sqrt({_DOT.format(a='ix.z', b='ix.z')}), 1e-12)"


def _knn_sql(dist: str, k: int) -> str:
    return f"""kd AS (SELECT q.id AS query_id, ix.id AS id, {dist} AS dist FROM q, ix WHERE q.id <> ix.id),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id)::INT AS rank FROM kd) WHERE rank <= {k})"""


def _split(spark, d):
    """The stated queries, and the whole table as the index; searches leave out the query's own id."""
    v = A.vectors(spark, d)
    return v.where("id % 50 = 0"), v


@query(f"WITH {_Q},\n{_knn_sql(_EU.format(a='q.z', b='ix.z'), 6)}\nSELECT query_id, rank, id, round(dist, 6) AS dist, round(exp(-dist / 3), 6) AS similarity FROM kn")
def knn_euclidean(spark, d):
    """J6, L1."""
    return A.rounded(R.knn(*_split(spark, d), 6))


@query(f"WITH {_Q},\n{_knn_sql(_COS, 6)}\nSELECT query_id, rank, id, round(dist, 6) AS dist, round(exp(-dist / 3), 6) AS similarity FROM kn")
def knn_cosine(spark, d):
    """J6, L1."""
    return A.rounded(R.knn(*_split(spark, d), 6, "cosine"))


@query(f"""WITH {_Q},
kx AS (SELECT q.id AS query_id, ix.id // 3 AS id, min({_EU.format(a='q.z', b='ix.z')}) AS dist FROM q, ix WHERE (ix.id // 3) % 7 <> 0 AND ix.id // 3 <> q.id GROUP BY ALL)
SELECT query_id, rank, id, round(dist, 6) AS dist, round(exp(-dist / 3), 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id)::INT AS rank FROM kx) WHERE rank <= 6""")
def knn_excluded(spark, d):
    """Three vectors share an id, and every seventh id is no answer."""
    q, ix = _split(spark, d)
    ix = ix.withColumn("id", F.floor(F.col("id") / 3))
    return A.rounded(R.knn_distinct(q, ix, 6, exclude=ix.where("id % 7 = 0").select("id")))


_ALL = A.SQL["vec"] + f",\nad AS (SELECT a.id AS query_id, b.id AS id, {_EU.format(a='a.z', b='b.z')} AS dist FROM vec a, vec b WHERE a.id <> b.id)"


@query(f"WITH {_ALL}\nSELECT query_id, rank, id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id)::INT AS rank FROM ad) WHERE rank <= 8")
def all_knn(spark, d):
    """J7."""
    return A.rounded(R.all_knn(A.vectors(spark, d)))


@query(f"WITH {_ALL}\nSELECT query_id AS id, round(min(dist), 6) AS dist FROM ad GROUP BY 1")
def internal_nn(spark, d):
    """J8."""
    return A.rounded(R.internal_nn(A.vectors(spark, d)))


@query(f"""WITH {_Q}, nn AS (SELECT a.id, min({_EU.format(a='a.z', b='b.z')}) AS m FROM ix a, ix b WHERE a.id <> b.id GROUP BY 1), th AS (SELECT quantile_cont(m, 0.95) AS t FROM nn),
near AS (SELECT q.id AS query_id, min({_EU.format(a='q.z', b='ix.z')}) AS nearest FROM q, ix WHERE q.id <> ix.id GROUP BY 1) SELECT query_id, round(nearest, 6) AS nearest, round(t, 6) AS threshold, nearest > t AS ood FROM near, th""")
def ood_flag(spark, d):
    """A23."""
    return A.rounded(R.ood_flags(*_split(spark, d)))


_MOT = f"{_Q},\nmc AS (SELECT motif, list(x ORDER BY p) AS c FROM (SELECT motif, p, avg(z[p]) AS x FROM ix, range(1, 65) r(p) GROUP BY ALL) GROUP BY 1)"


@query(f"""WITH {_MOT}
SELECT query_id, rank, motif, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, motif)::INT AS rank FROM (SELECT q.id AS query_id, mc.motif, {_EU.format(a='q.z', b='mc.c')} AS dist FROM q, mc)) WHERE rank <= 5""")
def motif_retrieval(spark, d):
    """J9, A24, L2."""
    q, ix = _split(spark, d)
    return A.rounded(R.motif_hits(q, M.centroids(ix)))


@query(f"WITH {A.SQL['vec']}\nSELECT (p - 1)::INT AS pos, round(avg(z[p]), 6) AS mean, round(quantile_cont(z[p], 0.5), 6) AS median FROM vec, range(1, 65) r(p) GROUP BY p")
def cloud_mean_median(spark, d):
    """A25."""
    return A.rounded(R.cloud_center(A.vectors(spark, d)))


_TAXA = f"""{_Q},
sz AS (SELECT taxon, count(*) AS n, count(*) FILTER (label_source = 'human') AS n_human FROM ix GROUP BY 1),
il AS (SELECT taxon, p, z[p] AS x FROM ix, range(1, 65) r(p)), ql AS (SELECT p, z[p] AS x FROM q, range(1, 65) r(p)),
sd AS (SELECT p, greatest(stddev_pop(x), 1e-9) AS sd FROM il GROUP BY 1), qm AS (SELECT p, avg(x) AS m FROM ql GROUP BY 1),
ce AS (SELECT taxon, sqrt(sum((im - m) * (im - m))) AS centroid_dist FROM (SELECT taxon, p, avg(x) AS im FROM il GROUP BY ALL) JOIN qm USING (p) GROUP BY 1),
bo AS (SELECT taxon, p, x, 0 AS a, 1 AS b FROM il UNION ALL SELECT taxon, p, x, 1, 0 FROM ql, (SELECT DISTINCT taxon FROM ix)),
pv AS (SELECT taxon, p, x, sum(a) AS a, sum(b) AS b FROM bo GROUP BY ALL),
pc AS (SELECT taxon, p, x, sum(a) OVER w / sum(a) OVER t AS fa, sum(b) OVER w / sum(b) OVER t AS fb, lead(x) OVER w AS nx FROM pv WINDOW w AS (PARTITION BY taxon, p ORDER BY x), t AS (PARTITION BY taxon, p)),
w1 AS (SELECT taxon, avg(w / sd) AS w1_mean FROM (SELECT taxon, p, sum(abs(fa - fb) * (nx - x)) AS w FROM pc GROUP BY ALL) JOIN sd USING (p) GROUP BY 1),
be AS (SELECT taxon, avg(exp(-dm / 3)) AS mean_best FROM (SELECT ix.taxon, q.id, min({_EU.format(a='q.z', b='ix.z')}) AS dm FROM q, ix WHERE q.id <> ix.id GROUP BY ix.taxon, q.id) GROUP BY 1),
al AS (SELECT *, mean_best * n / (n + 5) AS score FROM sz JOIN ce USING (taxon) JOIN w1 USING (taxon) JOIN be USING (taxon))
SELECT taxon, n, n_human, round(centroid_dist, 6) AS centroid_dist, round(w1_mean, 6) AS w1_mean, round(mean_best, 6) AS mean_best, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, taxon)::INT AS rank FROM al) WHERE rank <= 6"""


@query(f"WITH {_TAXA}")
def taxa_ranking(spark, d):
    """A22, J10."""
    return A.rounded(R.taxa_ranking(*_split(spark, d)))


_FEATS = tuple(f for g in GROUPS.values() for f in g)
_BREAK = " UNION ALL ".join(f"SELECT a.episode_id AS pair_id, '{g}' AS \"group\", ({' + '.join(f'abs(a.{f} - b.{f}) / greatest(s.{f}, 1e-9)' for f in fs)}) / {len(fs)} AS mean_diff FROM vfeat a JOIN vfeat b ON b.episode_id = a.episode_id + 1, sp s" for g, fs in GROUPS.items())


@query(A.sql(f"SELECT pair_id, \"group\", round(mean_diff, 6) AS mean_diff, CASE WHEN mean_diff < 0.35 THEN 'very high' WHEN mean_diff < 0.8 THEN 'high' WHEN mean_diff < 1.5 THEN 'moderate' ELSE 'low' END AS level FROM ({_BREAK})", "vfeat").replace("\nSELECT pair_id", ",\nsp AS (SELECT " + ", ".join(f"stddev_pop({f}) AS {f}" for f in _FEATS) + " FROM vfeat)\nSELECT pair_id", 1))
def similarity_breakdown(spark, d):
    """Each episode against the next id."""
    f = K.velocity_features(A.velocity(spark, d)).select("episode_id", *_FEATS)
    a = f.select(F.col("episode_id").alias("pair_id"), *[F.col(c).alias(f"a_{c}") for c in _FEATS])
    b = f.select((F.col("episode_id") - 1).alias("pair_id"), *[F.col(c).alias(f"b_{c}") for c in _FEATS])
    spread = f.agg(*[F.stddev_pop(c).alias(c) for c in _FEATS])
    out = R.similarity_breakdown(a.join(b, "pair_id"), spread, GROUPS)
    return A.rounded(out.withColumn("level", similarity_level(F.col("mean_diff"))))


@query(f"WITH {_Q},\n{_knn_sql(_EU.format(a='q.z', b='ix.z'), 6)},\nkd2 AS (SELECT q.id AS query_id, ix.id AS id, {_EU.format(a='q.z[1:32]', b='ix.z[1:32]')} AS dist FROM q, ix WHERE q.id <> ix.id), kn2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM kd2) WHERE rank <= 6)\nSELECT a.query_id, round(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))), 6) AS jaccard FROM (SELECT query_id, list(id) AS l FROM kn GROUP BY 1) a JOIN (SELECT query_id, list(id) AS l FROM kn2 GROUP BY 1) b USING (query_id)")
def neighbor_jaccard(spark, d):
    """The whole vectors against their first halves."""
    q, ix = _split(spark, d)
    half = lambda t: t.withColumn("z", F.slice("z", 1, 32))
    return A.rounded(R.agreement(R.knn(q, ix, 6), R.knn(half(q), half(ix), 6)))


def _hull_sql(name: str, z: str) -> str:
    """in_<name>: queries nearer to the index than 95 % of its own rows are to one another."""
    d = _EU.format(a=f"a.{z}", b=f"b.{z}")
    return f"""{name}_nn AS (SELECT a.id, min({d}) AS d FROM vec a, vec b WHERE a.id <> b.id GROUP BY a.id),
in_{name} AS (SELECT id AS query_id FROM {name}_nn WHERE id % 50 = 0 AND d <= (SELECT quantile_cont(d, 0.95) FROM {name}_nn)),
{name}_hit AS (SELECT query_id, list(id) AS l FROM (SELECT a.id AS query_id, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {d}, b.id) AS rank FROM vec a, vec b WHERE a.id % 50 = 0 AND a.id <> b.id) WHERE rank <= 6 GROUP BY 1)"""


@query(f"WITH {A.SQL['vec']}, {_hull_sql('whole', 'z')}, {_hull_sql('half', 'z[1:32]')}\nSELECT a.query_id, round(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))), 6) AS jaccard FROM whole_hit a JOIN half_hit b USING (query_id) WHERE query_id IN (FROM in_whole) AND query_id IN (FROM in_half)")
def agreement_inside(spark, d):
    """The whole vectors against their first halves, where neither finds a query novel."""
    whole, half = _split(spark, d), [t.withColumn("z", F.slice("z", 1, 32)) for t in _split(spark, d)]
    return A.rounded(R.agreement_inside(R.knn(*whole, 6), R.knn(*half, 6), R.ood_flags(*whole), R.ood_flags(*half)))


@query(f"WITH {_ALL}, hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM ad) WHERE rank <= 8), s AS (SELECT grp, count(*) AS n FROM vec GROUP BY 1)\nSELECT round(avg(CASE WHEN query_id % 20 = id % 20 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share, (SELECT round(sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)), 6) FROM s) AS chance FROM hit")
def same_video_fraction(spark, d):
    """A27."""
    v = A.vectors(spark, d)
    return A.rounded(R.same_group_share(R.all_knn(v), v.select("id", "grp")))


@query(f"WITH {_MOT}, asg AS (SELECT id, taxon, arg_min(m, (dist, m)) AS motif FROM (SELECT ix.id, ix.taxon, mc.motif AS m, {_EU.format(a='ix.z', b='mc.c')} AS dist FROM ix, mc) GROUP BY ALL)\nSELECT id AS episode_id, motif FROM asg")
def kmeans_assign(spark, d):
    """M4: one assignment to given centres."""
    ix = A.vectors(spark, d)
    return M.assign(ix.select(F.col("id").alias("episode_id"), "z"), M.centroids(ix)).select("episode_id", "motif")


@query(f"WITH {_Q}, t AS (SELECT DISTINCT taxon FROM ix), m AS (SELECT DISTINCT motif FROM ix), c AS (SELECT t.taxon, m.motif, count(ix.id) AS n FROM t CROSS JOIN m LEFT JOIN ix ON ix.taxon = t.taxon AND ix.motif = m.motif GROUP BY ALL)\nSELECT taxon, motif, n, round(n / sum(n) OVER (PARTITION BY taxon), 6) AS share FROM c")
def motif_occupancy(spark, d):
    """A9."""
    return A.rounded(M.occupancy(A.vectors(spark, d).select("taxon", "motif"), "taxon"))


@query(A.sql("SELECT motif, count(*) AS n, round(count(*) / (SELECT count(*) FROM vec), 6) AS share FROM vec GROUP BY 1", "vec"))
def motif_share(spark, d):
    """A33."""
    return A.rounded(AT.motif_share(A.vectors(spark, d)))


# --- detections and atlas -----------------------------------------------------------


def detections(spark, d):
    """Every event as a box in the frame of its hour; the confidence follows the frame."""
    s = A.points(spark, d)
    return s.select("event_id", F.col("scene").alias("video_id"), (F.col("frame") % 97).alias("frame"), (F.col("x") - 3).alias("x1"), (F.col("y") - 3).alias("y1"), (F.col("x") + 3).alias("x2"), (F.col("y") + 3).alias("y2"), ((F.col("frame") * 7 + F.col("episode_id")) % 100 / 100.0).alias("confidence"), F.col("label").alias("cls"))


A.SQL["det"] = A.SQL["trk"] + ",\ndet AS (SELECT event_id, scene AS video_id, frame % 97 AS frame, x - 3 AS x1, y - 3 AS y1, x + 3 AS x2, y + 3 AS y2, ((frame * 7 + episode_id) % 100 / 100.0)::DOUBLE AS confidence, label AS cls FROM pts)"


@query(A.sql("""SELECT video_id, frame, cls, round(confidence, 6) AS confidence, round(greatest(0.5, least(0.95, 0.5 + 0.45 * (confidence - 0.3) / 0.7)), 6) AS recalibrated, CASE WHEN confidence >= 0.5 THEN 'high' WHEN confidence >= 0.15 THEN 'low' ELSE 'none' END AS band,
CASE WHEN contains(cls, 'ant') THEN 'ant' WHEN contains(cls, 'spider') THEN 'spider' ELSE 'unknown' END AS class FROM (SELECT *, count(*) OVER (PARTITION BY video_id, frame) AS n FROM det) WHERE n <= 40""", "det"))
def chaos_guard(spark, d):
    """P13, P14, P15, S9."""
    rows = T.chaos_guard(detections(spark, d))
    return A.rounded(rows.select("video_id", "frame", "cls", "confidence", recalibrated_confidence(F.col("confidence")).alias("recalibrated"), confidence_band(F.col("confidence")).alias("band"), normalize_class(F.col("cls")).alias("class")))


@query(A.sql("""SELECT count(*) AS n, round(max(o), 6) AS max_iou, round(sum(o), 4) AS sum_iou FROM (SELECT i / greatest(72 - i, 1e-9) AS o FROM (SELECT greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i FROM det a JOIN det b ON a.video_id = b.video_id AND a.frame = b.frame AND a.event_id < b.event_id))""", "det"))
def iou_matrix(spark, d):
    """Overlaps of the boxes of a frame, each pair once."""
    return T.overlaps(detections(spark, d)).select("n", F.round("max_iou", 6).alias("max_iou"), F.round("sum_iou", 4).alias("sum_iou"))


@query()
def nms(spark, d):
    """L5."""
    return A.rounded(T.nms(detections(spark, d)))


@query("""WITH f AS (SELECT c_custkey AS video_id, 600 + (c_custkey * 37) % 3000 AS width, 400 + (c_custkey * 53) % 2000 AS height FROM customer),
s AS (SELECT *, (SELECT list(v) FROM (SELECT unnest(range(0, greatest(width - 1024, 0) + 1, 819)) AS v)) AS xs, (SELECT list(v) FROM (SELECT unnest(range(0, greatest(height - 1024, 0) + 1, 819)) AS v)) AS ys FROM f),
e AS (SELECT *, CASE WHEN xs[-1] + 1024 < width THEN list_append(xs, greatest(0, width - 1024)) ELSE xs END AS xe, CASE WHEN ys[-1] + 1024 < height THEN list_append(ys, greatest(0, height - 1024)) ELSE ys END AS ye FROM s),
u AS (SELECT video_id, width, height, ye, unnest(xe) AS x FROM e), v AS (SELECT video_id, width, height, x, unnest(ye) AS y FROM u)
SELECT video_id, x, y, least(1024, width - x) AS w, least(1024, height - y) AS h FROM v""")
def tile_windows(spark, d):
    """T-10."""
    c = A.read(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), (600 + F.col("c_custkey") * 37 % 3000).alias("width"), (400 + F.col("c_custkey") * 53 % 2000).alias("height"))
    return T.tile_windows(c)


@query(A.sql("""SELECT video_id, frame, round(sum(CASE WHEN s >= 0.3 AND s <= 120 THEN dx ELSE 0 END) OVER w, 6) AS cx, round(sum(CASE WHEN s >= 0.3 AND s <= 120 THEN dy ELSE 0 END) OVER w, 6) AS cy FROM
(SELECT episode_id AS video_id, frame, x - 100 AS dx, y / 10 AS dy, sqrt((x - 100) * (x - 100) + (y / 10) * (y / 10)) AS s FROM trk) WINDOW w AS (PARTITION BY video_id ORDER BY frame)""", "trk"))
def camera_shift(spark, d):
    """P20, W18."""
    s = A.samples(spark, d).select(F.col("episode_id").alias("video_id"), "frame", (F.col("x") - 100).alias("dx"), (F.col("y") / 10).alias("dy"))
    return A.rounded(T.camera_shift(s))


@query(A.sql("SELECT episode_id AS video_id, frame, round(coalesce(abs(v - lag(v, 2) OVER w), 0), 6) AS c1, round(coalesce(abs(v - lag(v, 4) OVER w), 0), 6) AS c2, round(coalesce(abs(v - lag(v, 6) OVER w), 0), 6) AS c3 FROM (SELECT episode_id, i AS frame, v FROM vel) WINDOW w AS (PARTITION BY episode_id ORDER BY frame)", "vel"))
def motion_lag(spark, d):
    """T-5, sequential."""
    v = A.velocity(spark, d).select(F.col("episode_id").alias("video_id"), F.col("i").alias("frame"), "v")
    return A.rounded(T.lag_colour(v, 2).drop("v"))


@query()
def motion_ema(spark, d):
    """T-5, exponential."""
    s = A.velocity(spark, d).groupBy("episode_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("s"))
    return s.select("episode_id", F.posexplode(T.motion_colour(F.col("s"))).alias("i", "c")).select("episode_id", "i", "c.*")


def hourly_boxes(rows, user):
    """Boxes around x and y of rows in the video of the user's scene; the confidence follows the frame."""
    box = [(F.col(c) + k).alias(f"{c}{n}") for n, k in ((1, -3), (2, 3)) for c in ("x", "y")]
    confidence = (F.col("frame") * 7 + F.col(user)) % 100 / 100.0
    other = [c for c in rows.columns if c not in ("x", "y", user)]
    return rows.select(F.concat((F.col(user) % 10).cast("string"), F.lit("@"), (F.col(user) % 2).cast("string")).alias("video_id"), *other, *box, confidence.alias("confidence"))


def hourly_detections(spark, d):
    """Every event as a box in the frame of its hour."""
    return hourly_boxes(A.points(spark, d).select("episode_id", "frame", "x", "y"), "episode_id")


def tracked_events(spark, d, method):
    """Points of the tracks over all hours, each video in segments of 128."""
    return track_segments(hourly_detections(spark, d), 128, 32, method, greedy={"gap": 3})


def _event_truth(spark, d):
    return A.points(spark, d).select("scene", F.col("episode_id").cast("string").alias("animal"), "frame", "x", "y")


def _tracked(method):
    def run(spark, d):
        points = tracked_events(spark, d, method).withColumnRenamed("video_id", "scene").where("state = 'observed'")
        return A.rounded(T.match_truth(points, _event_truth(spark, d)))

    return run


@query()
def track_greedy(spark, d):
    """T-1, A29: tracks of all events, and the user that each follows."""
    return _tracked("greedy")(spark, d)


@query()
def track_two_stage(spark, d):
    """T-2, T-11, A29: likewise, in two stages."""
    return _tracked("two-stage")(spark, d)


@query()
def tracking_cost(spark, d):
    """A30, P9."""
    truth = _event_truth(spark, d)
    points = settled(tracked_events(spark, d, "two-stage"), "tracks")
    episodes = T.episodes_of(points, 1.0, 2.0).withColumnRenamed("video_id", "scene")
    return A.rounded(T.benchmark_cost(T.match_truth(points.withColumnRenamed("video_id", "scene"), truth), truth, episodes, 1.0))


@query(A.sql("SELECT b::INT AS bin, l.label, count(x.label) AS n FROM range(24) t(b) CROSS JOIN (SELECT DISTINCT label FROM pts) l LEFT JOIN (SELECT label, frame % 24 AS hour FROM pts) x ON x.hour = b AND x.label = l.label GROUP BY ALL", "trk"))
def activity_by_hour(spark, d):
    """The river of labels over the day."""
    return AT.river(A.points(spark, d).select("label", (F.col("frame") % 24).alias("hour")))


@query(A.sql("SELECT episode_id, round(duration_s, 6) AS duration_s FROM vfeat ORDER BY (episode_id % 3 = 0) DESC, least(duration_s, 0.7) DESC, episode_id LIMIT 1", "vfeat"))
def hero(spark, d):
    """A34."""
    f = K.velocity_features(A.velocity(spark, d)).select("episode_id", "duration_s")
    rows = f.withColumns({"reviewed": F.col("episode_id") % 3 == 0, "full": F.col("duration_s"), "duration_s": F.least("duration_s", F.lit(0.7))})
    return A.rounded(AT.hero(rows).select("episode_id", F.col("full").alias("duration_s")))


@query()
def atlas_slim(spark, d):
    """K8."""
    f = settled(labelled_features(spark, d), "features")
    z = settled(K.feature_matrix(f), "matrix")
    emb = z.select("episode_id", M.fit_pca(z, 2).transform(F.col("z")).alias("z"))
    centre, _ = M.kmeans(z, 6)
    near = R.all_knn(M.standardized(f, DIMS).select(F.col("episode_id").alias("id"), F.array(*DIMS).alias("z")))
    return AT.slim(f.select("episode_id", "label"), emb, M.assign(z, M.centre_table(spark, centre)), near)


@query(A.sql("SELECT scene, count(DISTINCT episode_id) AS episodes, count(*) AS samples, max(rn) AS longest FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY frame, event_id) AS rn FROM pts) GROUP BY scene", "trk"))
def scene_sizes(spark, d):
    """J2."""
    s = A.points(spark, d).withColumn("rn", F.row_number().over(W.partitionBy("episode_id").orderBy("frame", "event_id")))
    return s.groupBy("scene").agg(F.count_distinct("episode_id").alias("episodes"), F.count("*").alias("samples"), F.max("rn").cast("long").alias("longest"))
