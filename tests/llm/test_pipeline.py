"""The corpus pipeline's stages on the smallest tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaitspark.llm import neardup, secrets

from .test_operators import SCHEMA, awkward, brute_components, check_packed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_columns_and_clean_rows(spark, staged):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for a, b in zip(staged[:4], staged[1:5], strict=True):
        assert b.columns == a.columns and b.count() <= a.count()
    kept = staged[1].join(labels, "doc_id")
    assert kept.where("toxic = 1").count() <= 0.5 * staged[0].join(labels, "doc_id").where("toxic = 1").count()
    assert kept.where("toxic = 0").count() == staged[0].join(labels, "doc_id").where("toxic = 0").count()
    good = "quality = 1"
    assert staged[2].join(labels, "doc_id").where(good).count() >= 0.95 * kept.where(good).count()


def test_one_document_of_each_group_stays(staged):
    rows = sorted((r["doc_id"], r["text"]) for r in staged[2].collect())
    _, comp = brute_components([t for _, t in rows], 80)
    want = sorted(rows[i][0] for i in set(comp))
    assert sorted(r["doc_id"] for r in staged[3].collect()) == want


def test_secrets_are_gone_and_all_is_packed(staged):
    after = staged[4].collect()
    assert not [r for r in after if secrets.base_spans(r["text"] or "")]
    assert all(r["n_chars"] == len(r["text"]) for r in after if "[SECRET]" in (r["text"] or ""))
    check_packed(staged[5].collect(), [(r["doc_id"], r["text"]) for r in after], 1024)


def test_run_gives_the_last_stage(spark, staged):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() == staged[5].count()


def test_stages_take_awkward_rows(spark):
    w = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, w, SF)
        assert out.columns == w.columns
        out.collect()
    once = corpus_pipeline.drop_near_duplicates(spark, w, SF)
    # Its two texts are unlike; the repeated one stays once.
    assert sorted(r["text"] for r in once.where(F.col("doc_id") == 3).collect()) == ["another text", "one"] and once.where("doc_id is null").count() == 1
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert public_tokenizers and neardup
