"""A corpus pipeline: toxicity, quality, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the docs of the next. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitspark.llm import neardup, packing, quality, secrets, toxicity
from gaitspark.llm.common import marked, materialize

TOXIC_FROM = 0.5
QUALITY_FROM = 0.3
SIMILARITY = 80


def _scored(docs: DataFrame, score: Callable[[DataFrame], DataFrame], keep) -> DataFrame:
    """The rows of docs that keep holds for, with docs' own columns whatever their names."""
    packed = docs.select(docs["text"], F.struct("*").alias("_row"))
    return score(packed).where(keep).select("_row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a severity over 0 is under TOXIC_FROM."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(docs, lambda d: toxicity.score_toxicity(d, model, TOXIC_FROM), ~F.col("toxic"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of QUALITY_FROM or more."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(docs, lambda d: quality.score_quality(d, model), F.col("score") >= QUALITY_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id, once. Documents without doc_id stay.

    A repeated row (doc_id and text) stays once, whatever its other columns. Different
    texts under one doc_id are judged each by itself.
    """
    found = neardup.near_duplicates(docs, SIMILARITY).where("doc_id is not null")
    texts = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.first("kept").alias("kept"), F.first("group").alias("group"))
    texts = materialize(texts, "judged")
    first = texts.where("kept and group is not null").groupBy("group").agg(F.min("text_hash").alias("first"))
    kept = texts.where("kept").join(first, "group", "left").withColumn("stays", F.coalesce(F.col("text_hash") == F.col("first"), F.lit(True)))
    # Texts that go, or stay as one of several rows; all others need no shuffle.
    act = kept.where("not stays or n > 1").select("doc_id", "text_hash", "stays").union(texts.where("not kept").select("doc_id", "text_hash", F.lit(False)))
    act = materialize(act, "dropped").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("stays").alias("_stays"))
    key = F.xxhash64("_id", "_hash")
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), F.xxhash64(docs["text"]).alias("_hash"), F.struct("*").alias("_row"))
    rows = marked(rows, F.when(F.col("_id").isNotNull(), key), act, key)
    likely = rows.where("_marked").join(act, ["_id", "_hash"], "left")
    once = likely.where("_stays").groupBy("_id", "_hash").agg(F.first("_row").alias("_row"))
    return rows.where("not _marked").select("_row.*").union(likely.where("_stays is null").select("_row.*")).union(once.select("_row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by marks."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024: doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), 1024, numbered=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Tokenizing, fitted models and signatures have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
