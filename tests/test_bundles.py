import json
import os

import pytest
from pyspark.sql import functions as F

from gaitspark.sources import bundles as B

KINDS = "section string, key string, place long, body string"
ROWS = [
    ("about", None, None, '{"k":6,"note":"é \\u2028"}'), ("hits", "q1", 2, '{"id":7,"dist":0.1}'), ("hits", "q1", 1, '{"id":9,"dist":null}'), ("hits", "q2", 1, "[]"), ("empty", "x", None, None),
    *[("meta", f"e{i:03d}", 0, json.dumps({"series": [i, i / 7]})) for i in range(200)],
]


def _plain(df):
    return sorted((r["section"], r["key"] or "", r["place"], json.dumps(json.loads(r["body"]))) for r in df.collect())


def _files(path):
    return sorted(f for _, _, files in os.walk(path) for f in files)


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "b")
    assert B.read_bundle(spark, path).count() == 0
    B.write_bundle(spark.createDataFrame(ROWS, KINDS).repartition(5), path, ("meta",))
    got = _plain(B.read_bundle(spark, path))
    want = [("about", "", 0, json.dumps(json.loads(ROWS[0][3]))), ("empty", "x", 0, "null"), ("hits", "q1", 0, '{"id": 9, "dist": null}'), ("hits", "q1", 1, '{"id": 7, "dist": 0.1}'), ("hits", "q2", 0, "[]")]
    assert got == sorted(want + [(s, k, p, json.dumps(json.loads(b))) for s, k, p, b in ROWS if s == "meta"])
    (version,) = B.versions(path)
    document = json.loads((tmp_path / "b" / version / "document.json").read_text(encoding="utf-8"))
    assert document["about"]["k"] == 6 and document["hits"]["q1"][1] == {"id": 7, "dist": 0.1} and "meta" not in document
    assert not [f for f in _files(path) if f.startswith("staged")]


def test_a_key_opens_few_files(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = spark.range(4000).select(F.lit("meta").alias("section"), F.format_string("e%05d", "id").alias("key"), F.lit(0).alias("place"), F.to_json(F.struct("id")).alias("body"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        B.write_bundle(rows, path, ("meta",))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    whole, one = B.BundleReader({"path": path, "section": "meta"}), B.BundleReader({"path": path, "section": "meta", "key": "e01234"})
    assert len(whole.partitions()) == 4 and len(one.partitions()) == 1
    assert [r["body"] for r in B.read_bundle(spark, path, "meta", "e01234").collect()] == ['{"id":1234}']


def test_newest_version_and_older(spark, tmp_path):
    path = str(tmp_path / "b")
    for i in (1, 2):
        B.write_bundle(spark.createDataFrame([("a", None, None, str(i))], KINDS), path)
    newest, oldest = B.versions(path)
    assert [B.read_bundle(spark, path, version=v).first()["body"] for v in (None, newest, oldest)] == ["2", "2", "1"]
    os.remove(f"{path}/{newest}/manifest.json")  # a writer that died before its commit
    assert B.read_bundle(spark, path).first()["body"] == "1"


@pytest.mark.parametrize(
    "rows, options",
    [
        (ROWS, {"budget": 100}), ([("a", str(i), 0, '"' + "x" * 40 + '"') for i in range(20)], {"budget": 600}), ([(None, None, None, "1")], {}), ([("a", None, None, "{")], {}), ([("a", None, None, "NaN")], {}),
        ([("a", None, None, "1"), ("a", None, None, "2")], {}), ([("a", None, None, "1"), ("a", "k", None, "2")], {}), ([("meta", "k", 0, "1"), ("meta", None, 0, "1")], {}),
    ],
)
def test_a_failed_write_leaves_nothing(spark, tmp_path, rows, options):
    path = str(tmp_path / "b")
    B.write_bundle(spark.createDataFrame([("a", None, None, "0")], KINDS), path)
    before = _files(path), B.versions(path)
    with pytest.raises(Exception, match="ValueError|JSONDecodeError|budget|section|key"):
        B.write_bundle(spark.createDataFrame(rows, KINDS).repartition(4), path, ("meta",), **options)
    assert (_files(path), B.versions(path)) == before and len(os.listdir(path)) == 1
    assert B.read_bundle(spark, path).first()["body"] == "0"


def test_empty_bundle(spark, tmp_path):
    path = str(tmp_path / "b")
    B.write_bundle(spark.createDataFrame([], KINDS), path, ("meta",))
    assert len(B.versions(path)) == 1 and B.read_bundle(spark, path).count() == 0


def test_sections(spark):
    df = spark.createDataFrame([("q", 1, 0.5, None)], "id string, rank int, dist double, label string")
    (r,) = B.section("hits", df, "id", "rank").collect()
    assert (r["section"], r["key"], r["place"], json.loads(r["body"])) == ("hits", "q", 1, {"dist": 0.5, "label": None})
    (u,) = B.unpacked(B.section("hits", df, "id", "rank"), "dist double, label string").collect()
    assert tuple(u) == ("q", 1, 0.5, None)


def test_frames_come_back_with_their_types(spark, tmp_path):
    path = str(tmp_path / "b")
    assert B.load_frames(spark, path) == {}
    hits = spark.createDataFrame([(5, 1, 0.1, ["x", None]), (5, 2, float("nan"), []), (None, 1, None, None)], "query_id long, rank int, dist double, why array<string>")
    frames = {"hits": hits, "none": hits.limit(0), "about": spark.createDataFrame([("k", "6")], "name string, value string"), "twice": spark.createDataFrame([("a",), ("a",)], "v string")}
    for document in ((), tuple(frames), ("about",)):
        B.save_frames(frames, path, document)
        got = B.load_frames(spark, path)
        assert set(got) == set(frames)
        for name, frame in frames.items():
            assert [(f.name, f.dataType) for f in got[name].schema] == [(f.name, f.dataType) for f in frame.schema]
            assert sorted(map(str, got[name].collect())) == sorted(map(str, frame.collect()))


def test_what_does_not_fit_the_document_is_kept_as_parts(spark, tmp_path):
    path = str(tmp_path / "b")
    big = spark.range(2000).select(F.format_string("e%04d", "id").alias("key"), F.repeat(F.lit("x"), 20).alias("v"))
    B.save_frames({"small": big.limit(3), "big": big}, path, ("small", "big"), budget=20_000)
    (version,) = B.versions(path)
    document = json.loads((tmp_path / "b" / version / "document.json").read_text())
    assert set(document) == {"small", "columns"} and len(document["small"]) == 3
    assert B.load_frames(spark, path)["big"].count() == 2000
