"""The engine's entry points: analyse a run, interactions, build a reference, find similar, evaluate.

Each returns a dictionary of DataFrames; nothing is computed before they are used,
but for the model fits, and nothing is written but by the functions in sources;
bundles.save_frames() keeps such a dictionary as one bundle and load_frames() gives it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import effective_label, heuristic_label, label_source, similarity_level
from ..operators import atlas, hierarchy, interaction, kinematics, labels, models, retrieval, stats, tracking
from ..schema import FEATURES
from ..session import settled
from ..sources import default_scenes

# What the fingerprint and the breakdown compare.
FINGERPRINT = ("speed_mean", "speed_cv", "frac_time_moving", "turn_rate_mean", "sinuosity")
GROUPS = {
    "trajectory_geometry": ("sinuosity", "straightness_index", "net_displacement", "curvature_mean", "distance"), "speed_dynamics": ("speed_mean", "speed_p90", "accel_rms"),
    "turning_dynamics": ("turn_rate_mean", "turn_rate_p90"), "stop_go_rhythm": ("frac_time_moving", "n_pauses", "pause_run_mean_s", "move_run_mean_s"), "intermittency": ("speed_cv",),
}


def episode_features(samples: DataFrame | None, velocity: DataFrame | None) -> DataFrame:
    """Features of tracks and of speed series in one table."""
    parts = ([kinematics.trajectory_features(samples)] if samples is not None else []) + ([kinematics.velocity_features(velocity)] if velocity is not None else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def analyze(episodes: DataFrame, features: DataFrame, log: DataFrame | None = None, aspect: Column | None = None, k: int = 8) -> dict[str, DataFrame]:
    """Labels, label-blind embedding, motifs, motif profile and fingerprint of a run.

    Human records come before machine labels, and machine labels only go where none
    is. Labels are joined after the features and never reach the embedding.
    """
    rows = labels.apply_annotations(episodes, log) if log is not None else episodes
    label, sure = heuristic_label(aspect if aspect is not None else F.lit(1.0), F.col("speed_cv"), F.col("n_pauses"), F.col("duration_s"))
    machine = features.select("episode_id", label.alias("_label"), sure.cast("double").alias("_sure"))
    rows = rows.join(machine, "episode_id", "left").withColumns({"machine_label": F.coalesce("machine_label", "_label"), "machine_confidence": F.coalesce("machine_confidence", "_sure")}).drop("_label", "_sure")
    labelled = rows.select("episode_id", effective_label().alias("label"), label_source().alias("source"))
    z = settled(kinematics.feature_matrix(features), "matrix")
    pca = models.fit_pca(z, 2)
    embedding = z.select("episode_id", pca.transform(F.col("z")).alias("z"))
    centre, _ = models.kmeans(z, k)
    motifs = models.assign(z, models.centre_table(z.sparkSession, centre)).select("episode_id", "motif")
    labelled_features = features.join(labelled, "episode_id")
    return {
        "episodes": rows, "labels": labelled, "embedding": embedding, "motifs": motifs, "motif_profile": models.occupancy(motifs.join(labelled, "episode_id")), "label_counts": labelled.groupBy("label").agg(F.count("*").alias("n")),
        "fingerprint": stats.fingerprint(labelled_features, FINGERPRINT), "river": atlas.motif_share(motifs),
    }


def interact(samples: DataFrame, spans: DataFrame, features: DataFrame, radius: float = 200.0, shuffles: int = 200, window_s: float = 2.0, stride_s: float = 1.0) -> dict[str, DataFrame]:
    """Pairs, contexts, windows, and contrasts of focal animals with and without ants near, at half to four times the radius."""
    context = interaction.neighbor_context(samples, [radius * m for m in (0.5, 1.0, 2.0, 4.0)])
    labelled = features.join(samples.groupBy("episode_id").agg(F.first("label").alias("label")), "episode_id")
    d = interaction.d_ant(labelled, FINGERPRINT).select("episode_id", "d_ant")
    return {
        "pairs": interaction.pair_geometry(samples), "context": context.where(F.col("radius") == radius), "windows": interaction.scene_windows(spans, window_s, stride_s), "d_ant": d,
        "response": interaction.ant_contrast(context, features.select("episode_id", "speed_mean", "frac_time_moving", "turn_rate_mean").join(d, "episode_id"), ("speed_mean", "frac_time_moving", "turn_rate_mean", "d_ant"), shuffles=shuffles),
    }


def build_reference(episodes: DataFrame, features: DataFrame, policy: str = "not-rejected", min_duration: float = 3.0, dim: int = 10, k: int = 8) -> dict:
    """Encoder fitted on all episodes, index of the accepted ones with motif and label, centroids, spread of features."""
    z = kinematics.feature_matrix(features)
    encoder = models.fit_pca(z, dim)
    coded = z.select("episode_id", encoder.transform(F.col("z")).alias("z"))
    rows = episodes.join(features.select("episode_id", "duration_s"), "episode_id").withColumn("kept", labels.accepts(F.col("duration_s"), policy, min_duration))
    entries = rows.where("kept").join(coded, "episode_id").select(F.col("episode_id").alias("id"), "z", effective_label().alias("taxon"), label_source().alias("label_source"))
    entries = settled(entries, "entries")
    centre, _ = models.kmeans(entries, k)
    assigned = models.assign(entries.withColumnRenamed("id", "episode_id"), models.centre_table(z.sparkSession, centre)).select(F.col("episode_id").alias("id"), "z", "taxon", "label_source", "motif")
    return {
        "encoder": encoder, "entries": assigned, "motifs": models.centroids(assigned), "spread": features.agg(*[F.stddev_pop(f).alias(f) for f in FEATURES]),
        "counts": rows.groupBy("kept").agg(F.count("*").alias("n")), "taxa": assigned.groupBy("taxon").agg(F.count("*").alias("n")), "features": features,
    }


def find_similar(reference: dict, queries: DataFrame, k: int = 6, min_duration: float = 3.0, metric: str = "euclidean", exclude: DataFrame | None = None, second: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Screened queries (features with coverage), their neighbours, motifs, taxa, novelty and the breakdown against each one's best hit.

    exclude: ids that are no answer. second: queries and index (id, z) in another
    representation; it gives neighbours and novelty of its own, and the agreement of both over the
    queries that neither finds novel.
    """
    screened = labels.screen_queries(queries, min_duration)
    used = screened.where("used")
    coded = kinematics.feature_matrix(used).select(F.col("episode_id").alias("id"), reference["encoder"].transform(F.col("z")).alias("z"))
    index = reference["entries"]
    hits = retrieval.knn_distinct(coded, index, k, metric, exclude)
    novelty = retrieval.ood_flags(coded, index, metric)
    best = hits.where(F.col("rank") == 1).select(F.col("query_id").alias("pair_id"), "id")
    a = used.select(F.col("episode_id").alias("pair_id"), *[F.col(f).alias(f"a_{f}") for f in FEATURES])
    b = reference["features"].select(F.col("episode_id").alias("id"), *[F.col(f).alias(f"b_{f}") for f in FEATURES])
    broken = retrieval.similarity_breakdown(a.join(best, "pair_id").join(b, "id"), reference["spread"], GROUPS)
    other = {}
    if second:
        own = second[0].join(coded.select("id"), "id", "left_semi")
        hits_b, novelty_b = retrieval.knn_distinct(own, second[1], k, metric, exclude), retrieval.ood_flags(own, second[1], metric)
        other = {"second_hits": hits_b, "second_novelty": novelty_b, "agreement": retrieval.agreement_inside(hits, hits_b, novelty, novelty_b)}
    return other | {
        "screened": screened, "hits": hits, "motifs": retrieval.motif_hits(coded, reference["motifs"]), "taxa": retrieval.taxa_ranking(coded, index), "novelty": novelty,
        "breakdown": broken.withColumn("level", similarity_level(F.col("mean_diff"))), "center": retrieval.cloud_center(coded),
    }


def evaluate_retrieval(samples: DataFrame, groups: DataFrame, encoder: models.Projection, k: int = 8, seed: int = 0) -> dict[str, DataFrame]:
    """Share of neighbours from the same group against chance, and what stays after rotation, shift and jitter.

    Features of the changed tracks are computed anew.
    """

    def near(rows: DataFrame) -> DataFrame:
        z = kinematics.feature_matrix(kinematics.trajectory_features(rows))
        return retrieval.all_knn(z.select(F.col("episode_id").alias("id"), encoder.transform(F.col("z")).alias("z")), k)

    base = near(samples)
    changed = {"rotate": kinematics.rotate(samples, 0.7), "translate": kinematics.translate(samples, 40.0, -25.0), "jitter": kinematics.jitter(samples, 0.5, seed)}
    return {"same_group": retrieval.same_group_share(base, groups)} | {n: retrieval.kept_share(base, near(rows), k) for n, rows in changed.items()}


def tracking_benchmark(spark, fps: float = 10.0, seconds: float = 8.0, min_s: float = 1.0) -> dict[str, DataFrame]:
    """Both trackers on the ground-truth scenes with their costs."""
    truth = tracking.truth_points(*default_scenes(spark), fps, seconds)
    box = {c: (F.col(c[0]) + d).alias(c) for c, d in (("x1", -8), ("y1", -8), ("x2", 8), ("y2", 8))}
    dets = truth.select(F.col("scene").alias("video_id"), "frame", *box.values(), F.lit(0.9).alias("confidence"))
    out = {}
    for method in ("greedy", "two-stage"):
        points = tracking.track(dets, method, greedy={"gap": 3})
        matched = tracking.match_truth(points.where("state = 'observed'").withColumnRenamed("video_id", "scene"), truth)
        episodes = tracking.episodes_of(points, fps, min_s).withColumnRenamed("video_id", "scene")
        out[method] = tracking.benchmark_cost(matched, truth, episodes, fps)
    return out


def sampling_summary(episodes: DataFrame, value: str = "value") -> dict[str, DataFrame]:
    """Counts, nested tree, distinct counts and the interval of a mean over the highest level that has two clusters."""
    level = hierarchy.auto_level(episodes)
    keys = hierarchy.LEVELS[: hierarchy.LEVELS.index(level) + 1]
    return {"counts": hierarchy.counts(episodes), "tree": hierarchy.tree(episodes), "distinct": hierarchy.distinct_counts(episodes), "interval": hierarchy.bootstrap_mean(episodes, value, F.concat_ws("/", *keys))}
