"""Annotation replay, label summaries, index policy, role lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import effective_label, label_source, qc_reasons
from ..schema import BIO_LABELS, QC_STATES, REJECTED_STATES


def latest_annotations(log: DataFrame, seq: str = "seq", by_layer: bool = False) -> DataFrame:
    """J5, T-8: the last record of each episode by sequence number.

    With by_layer each column keeps its last value that is not null, so that a later
    record with a state alone does not hide an earlier label.
    """
    if not by_layer:
        last = log.withColumn("nth", F.row_number().over(W.partitionBy("episode_id").orderBy(F.desc(seq))))
        return last.where("nth = 1").drop("nth", seq)
    value = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in log.columns if c not in ("episode_id", seq)]
    return log.groupBy("episode_id").agg(*value)


def apply_annotations(episodes: DataFrame, log: DataFrame, seq: str = "seq") -> DataFrame:
    """Episodes with human layer and state from the log; records of unknown episodes have no effect."""
    last = latest_annotations(log, seq).select("episode_id", F.col("human_label").alias("_label"), F.col("human_confidence").alias("_conf"), F.col("qc_state").alias("_state"))
    out = episodes.join(last, "episode_id", "left")
    given = F.col("_state").isNotNull()
    return out.withColumns({
        "human_label": F.when(given, F.col("_label")).otherwise(F.col("human_label")), "human_confidence": F.when(given, F.col("_conf")).otherwise(F.col("human_confidence")),
        "annotation_status": F.coalesce("_state", "annotation_status"),
    }).drop("_label", "_conf", "_state")


def validated(log: DataFrame) -> DataFrame:
    """K3: the log itself; running it fails on a label or state outside the vocabulary."""
    ok = (F.col("human_label").isNull() | F.col("human_label").isin(*BIO_LABELS)) & F.col("qc_state").isin(*QC_STATES)
    return log.withColumn("qc_state", F.when(ok, F.col("qc_state")).otherwise(F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.coalesce("human_label", F.lit("-")), F.lit(" / "), F.coalesce("qc_state", F.lit("-"))))))


def annotation_summary(episodes: DataFrame) -> DataFrame:
    """A4: (kind, name, n): every state with its count, zeros included, effective labels, and human against machine-only counts."""
    spark = episodes.sparkSession
    states = spark.createDataFrame([(s,) for s in QC_STATES], "name string")
    got = episodes.groupBy(F.coalesce("annotation_status", F.lit("unreviewed")).alias("name")).agg(F.count("*").alias("n"))
    by_state = states.join(got, "name", "left").select(F.lit("state").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    by_label = episodes.groupBy(effective_label().alias("name")).agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), "name", "n")
    by_source = episodes.groupBy(label_source().alias("name")).agg(F.count("*").alias("n")).select(F.lit("source").alias("kind"), "name", "n")
    return by_state.unionByName(by_label).unionByName(by_source)


def accepts(duration: Column, policy: str = "not-rejected", min_duration: float = 0.0, need_human: bool = False) -> Column:
    """Whether an episode may enter a reference index. Rejected states never do, whatever the policy."""
    ok = ~F.coalesce("annotation_status", F.lit("unreviewed")).isin(*REJECTED_STATES) & (duration >= min_duration)
    if policy == "reviewed":
        ok = ok & (F.col("annotation_status") == "accepted")
    if need_human:
        ok = ok & F.nullif("human_label", F.lit("")).isNotNull()
    return F.coalesce(ok, F.lit(False))


def screen_queries(episodes: DataFrame, min_duration: float = 3.0) -> DataFrame:
    """Adds reasons and used: the usable episodes, or all where none is usable."""
    rows = episodes.withColumn("reasons", qc_reasons(F.col("duration_s"), F.col("coverage"), F.col("distance"), min_duration))
    usable = F.size("reasons") == 0
    some = rows.agg(F.coalesce(F.bool_or(usable), F.lit(False)).alias("_some"))
    return rows.crossJoin(F.broadcast(some)).withColumn("used", usable | ~F.col("_some")).drop("_some")


def review_queue(episodes: DataFrame) -> DataFrame:
    """Unreviewed episodes, or all where none is left."""
    todo = F.coalesce("annotation_status", F.lit("unreviewed")) == "unreviewed"
    some = episodes.agg(F.coalesce(F.bool_or(todo), F.lit(False)).alias("_some"))
    return episodes.crossJoin(F.broadcast(some)).where(todo | ~F.col("_some")).drop("_some")


def session_state(episodes: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A review session's episodes with the log applied, and the queue of what to review next."""
    now = apply_annotations(episodes, log)
    return now, review_queue(now)


def overlapping_splits(splits: DataFrame) -> DataFrame:
    """U4: items of (split, item) that stand in more than one split, with these; none means the splits are disjoint."""
    found = splits.groupBy("item").agg(F.sort_array(F.collect_set("split")).alias("splits"))
    return found.where(F.size("splits") > 1)


def label_counts(episodes: DataFrame, labels: tuple[str, ...] = BIO_LABELS) -> DataFrame:
    """Episodes of each effective label, zeros included."""
    domain = episodes.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    got = episodes.groupBy(effective_label().alias("label")).agg(F.count("*").alias("n"))
    return domain.join(got, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def look_up_roles(taxa: DataFrame, roles: DataFrame) -> DataFrame:
    """Taxon, role and matched taxon: exact match, else either name begins with the other (the longest, then the first by name), else 'ant' in the name means model, else unknown.

    roles (taxon, role) is a dimension table of a few hundred rows at most.
    """
    known = roles.select(F.lower(F.trim("taxon")).alias("known"), "role")
    t = taxa.select("taxon").distinct().withColumn("key", F.lower(F.trim("taxon")))
    prefix = (F.length("known") > 0) & (F.length("key") > 0) & (F.col("key").startswith(F.col("known")) | F.col("known").startswith(F.col("key")))
    hits = t.join(F.broadcast(known), (F.col("key") == F.col("known")) | prefix)
    best = hits.groupBy("taxon").agg(F.min_by(F.struct("known", "role"), F.struct((F.col("key") != F.col("known")).alias("far"), (-F.length("known")).alias("size"), "known", "role")).alias("m"))
    out = t.join(best, "taxon", "left")
    role = F.coalesce("m.role", F.when(F.col("key").contains("ant"), "model"), F.lit("unknown"))
    return out.select("taxon", role.alias("role"), F.col("m.known").alias("matched"))
