import json
import zipfile
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitspark.operators import labels, retrieval, tracking
from gaitspark.operators.models import Projection
from gaitspark.sources import arena_samples, files, gait_rows, imports, register_sources, with_videos


def trial(n, species="Salticus senicus", **fields):
    return SimpleNamespace(Rcm_mm=np.stack([np.arange(n), np.arange(n) * 2.0], 1) if n else np.empty(0), species_name=species, file_name="GOPR01.MP4", date="2014-05-01", time=" 10:20 ", **fields)


def test_arena_trials_by_their_own_fields(spark):
    trials = [trial(130), trial(400, "ANT Lasius", data_first_frame=10, data_last_frame=409), trial(200, "1.3cm ball"), trial(119, "Myrmarachne formicaria"), trial(0), SimpleNamespace(species_name="ANT x"), trial(150, "Myrmarachne formicaria")]
    trials[0].Rcm_mm[:5] = np.nan
    rows = [r for i, t in enumerate(trials) for r in imports.trial_rows(t, f"t{i}")]
    df = spark.createDataFrame(rows, imports.ARENA)
    got = {r["episode_id"]: r for r in arena_samples(df).groupBy("episode_id", "label", "session_id", "first_frame", "last_frame", "fps").count().collect()}
    assert {k: (r["label"], r["count"]) for k, r in got.items()} == {"t0": ("other_spider", 130), "t1": ("ant", 400), "t6": ("mimic", 150)}
    assert (got["t1"]["first_frame"], got["t1"]["last_frame"]) == (10, 409) and (got["t0"]["first_frame"], got["t0"]["last_frame"]) == (0, 129)
    assert got["t0"]["session_id"] == "shamble2017_dryad/2014-05-01" and got["t0"]["fps"] == 120.0
    videos = spark.createDataFrame([("/v/gopr01_ns.mp4",), ("/v/other.mp4",)], "path string")
    assert {r["video_path"] for r in with_videos(arena_samples(df), videos).select("video_path").distinct().collect()} == {"/v/gopr01_ns.mp4"}


def test_matlab_files_need_scipy(spark, tmp_path):
    register_sources(spark)
    try:
        from scipy.io import savemat
    except ImportError:
        with pytest.raises(Exception, match="scipy"):
            spark.read.format("shamble").option("path", f"{tmp_path}/x.mat").load().collect()
        return
    cells = np.empty(1, object)
    cells[0] = {"Rcm_mm": np.ones((200, 2)), "species_name": "ANT x", "file_name": "a.mp4", "date": "d"}
    savemat(f"{tmp_path}/x.mat", {"data": cells})
    assert arena_samples(spark.read.format("shamble").option("path", f"{tmp_path}/x.mat").load()).count() == 200


def workbook(path, sheets):
    """A workbook with shared, inline and numeric cells."""
    cell = lambda ref, v: f'<c r="{ref}" t="s"><v>{v[1]}</v></c>' if isinstance(v, tuple) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>' if v is not None else ""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://x"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>one</t></si><si><r><t>tw</t></r><r><t>o </t></r></si></sst>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{k}">' + "".join(cell(f"{'ABCDE'[j]}{k}", v) for j, v in enumerate(row)) + "</row>" for k, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_gait_workbook(spark, tmp_path):
    head = ["id", "v", "l1", "l2"]
    first = [head] + [[("s", 0), 1.5, 0.25, 2]] * 150 + [[None, 9.0, 9.0, 9.0]] + [[("s", 1), "n/a", None, "7"]] * 151 + [["short", 1.0, 1.0, 1.0]] * 149
    workbook(f"{tmp_path}/g.xlsx", {"Siler collingwoodi_normal": first, "notes": [head, *[["x", 1.0, 1.0, 1.0]] * 200], "Polyrhachis dives": [head, *[["one", 2.0, None, 3.0]] * 150]})
    register_sources(spark)
    rows = gait_rows(spark.read.format("zeng").option("path", f"{tmp_path}/g.xlsx").load())
    got = {r["episode_id"]: r for r in rows.groupBy("episode_id", "label", "species", "session_id").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.count("limb1").alias("l1"), F.sum("limb2").alias("l2"), F.max("i").alias("last")).collect()}
    assert {k: (r["label"], r["species"], r["n"], r["v"], r["l1"], r["l2"], r["last"]) for k, r in got.items()} == {
        "Siler collingwoodi_normal/one": ("siler", "Siler collingwoodi", 150, 225.0, 150, 300.0, 149),
        "Siler collingwoodi_normal/two": ("siler", "Siler collingwoodi", 151, None, 0, None, 150),
        "Polyrhachis dives/one": ("ant", "Polyrhachis dives", 150, 300.0, 0, 450.0, 149),
    }


def test_old_logs_keep_their_order(spark, tmp_path):
    lines = [json.dumps({"episode_id": f"e{i % 7}", "qc_state": "accepted", "note": str(i)}) for i in range(4000)]
    (tmp_path / "log.jsonl").write_text("\n\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.read_annotation_log(spark, str(tmp_path / "log.jsonl"))
        assert spark.read.text(str(tmp_path / "log.jsonl")).select("_metadata.file_block_start").distinct().count() > 5
        rows = sorted((r["seq"], int(r["note"])) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [n for _, n in rows] == list(range(4000)) and len({s for s, _ in rows}) == 4000
    assert files.read_annotation_log(spark, str(tmp_path / "none")).count() == 0


def test_documents(spark, tmp_path):
    d = str(tmp_path)
    assert files.read_projection(spark, f"{d}/p") is None and not files.read_summary(spark, f"{d}/s").first()["available"]
    assert files.read_roles(spark, f"{d}/r").count() == 11 and files.read_motif_annotations(spark, f"{d}/m").count() == 0
    model = Projection(np.array([1.0, 2.0]), np.array([0.5, 1.0]), np.eye(2), np.array([0.7, 0.3]))
    files.write_projection(spark, model, f"{d}/p")
    assert files.read_projection(spark, f"{d}/p").checksum() == model.checksum()
    (tmp_path / "s").write_text('{\n "n_records": 4,\n "comparison": {"a": 1}\n}')
    assert tuple(files.read_summary(spark, f"{d}/s").first()) == (True, 4, 0, 0)
    curated = files.read_roles(spark, f"{d}/r").where("role = 'mimic'").withColumn("confidence", F.lit(0.9))
    files.write_roles(curated, f"{d}/r")
    back = files.read_roles(spark, f"{d}/r")
    assert back.columns == curated.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, curated.collect()))
    ratings = spark.createDataFrame([("q", "e", 5, "n" * 600)], "query_id string, episode_id string, rating int, note string")
    files.append_ratings(ratings, f"{d}/k")
    files.append_ratings(ratings, f"{d}/k")
    assert spark.read.json(f"{d}/k").where("length(note) = 500 and rated is not null").count() == 2
    with pytest.raises(Exception, match="rating"):
        files.append_ratings(ratings.withColumn("rating", F.lit(6)), f"{d}/k")


def test_detectors_and_backends_are_plugged_in(spark):
    tiles = spark.createDataFrame([("v", 0, 0.0, 0.0, 100.0, 100.0), ("v", 0, 80.0, 0.0, 100.0, 100.0), ("v", 1, 0.0, 0.0, 100.0, 100.0)], "video_id string, frame long, x double, y double, w double, h double")
    inside = [(85.0, 10.0), (150.0, 50.0)]

    def detect(t):
        for x, y in inside:
            if t["x"] <= x - 5 and x + 5 <= t["x"] + t["w"]:
                yield x - 5 - t["x"], y - 5, x + 5 - t["x"], y + 5, 0.5 + t["x"] / 1000, "ant"

    got = sorted((r["frame"], r["x1"], r["y1"], round(r["confidence"], 2)) for r in tracking.detect_tiles(tiles, detect).collect())
    assert got == [(0, 80.0, 5.0, 0.58), (0, 145.0, 45.0, 0.58), (1, 80.0, 5.0, 0.5)]
    z = spark.createDataFrame([(str(i), [float(i), 0.0]) for i in range(5)], "id string, z array<double>")
    assert retrieval.search(z.where("id = '0'"), z, 1).first()["id"] == "1"
    with pytest.raises(ValueError, match="backend"):
        retrieval.search(z, z, backend="graph")
    retrieval.BACKENDS["none"] = lambda q, i, k, m: i.limit(0)
    assert retrieval.search(z, z, backend="none").count() == 0
    del retrieval.BACKENDS["none"]
    assert labels.overlapping_splits(spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "split string, item int")).count() == 0


def test_exact_neighbours_by_pivots_with_any_ids(spark, monkeypatch):
    """String ids, several cells, blocks and turns, equal vectors, against brute force."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 40)
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(90, 3)), 20 + r.normal(size=(90, 3)), np.zeros((70, 3))])
    ids = [f"ep_{i:03d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id string, z array<double>")
    for metric in ("euclidean", "cosine"):
        rows = df if metric == "euclidean" else df.where("id < 'ep_180'")
        y = x if metric == "euclidean" else x[:180] / np.linalg.norm(x[:180], axis=1, keepdims=True)
        got = {}
        for h in retrieval.all_knn(rows, 4, metric).collect():
            got[h["query_id"], h["rank"]] = (h["id"], h["dist"])
        d = ((y[:, None] - y[None]) ** 2).sum(-1)
        d = np.sqrt(d) if metric == "euclidean" else d / 2
        np.fill_diagonal(d, np.inf)
        for i in range(len(y)):
            order = np.lexsort((np.arange(len(y)), np.round(d[i], 9)))[:4]
            assert np.allclose([got[ids[i], k + 1][1] for k in range(4)], d[i][order], atol=1e-9)
            if metric == "euclidean":
                assert [got[ids[i], k + 1][0] for k in range(4)] == [ids[j] for j in order]
    flags = retrieval.ood_flags(df.limit(5), df)
    assert flags.count() == 5
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 3)
    many = {(h["query_id"], h["rank"]): h["id"] for h in retrieval.knn(df, df, 2).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 20_000)
    assert many == {(h["query_id"], h["rank"]): h["id"] for h in retrieval.knn(df, df, 2).collect()}
