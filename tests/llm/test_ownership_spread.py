from gaitspark.llm import queries, secrets

LOOSE, BASE = "Zx9Qw8Er7Ty6Ui5Op4Lk3Jh2", "password=Example123456789"
SCHEMA = "doc_id long, text string, source string"


def found(spark, rows):
    return {r["doc_id"]: r["found"] for r in secrets.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_a_copy_under_a_second_source_hides_nothing(spark):
    rows = [(1, f"blob {LOOSE} end", "a"), (2, f"blob {LOOSE} end", "b"), (3, f"a near blob {LOOSE} end", "b")]
    got = found(spark, rows)
    assert all([(s["kind"], s["owners"], s["live"]) for s in got[i]] == [(3, 2, True)] for i in (1, 2, 3))
    clean = secrets.redact_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert not [r for r in clean if LOOSE in r["text"]]
    wide = found(spark, [*rows, (4, LOOSE, "c")])
    assert all(wide[i] == [] for i in range(1, 5))


def test_the_query_shows_them(spark, tmp_path):
    spark.createDataFrame([(1, LOOSE, "a"), (2, LOOSE, "b")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["spans"] for r in queries.op7_secret_ownership(spark, str(tmp_path)).collect()} == {f"owned:0:{len(LOOSE)}"}


def test_different_texts_of_one_owner_make_an_example(spark):
    n = secrets.SPREAD
    rows = [(i, f"text {i} has {LOOSE} and {BASE}", "hot") for i in range(n)]
    got = found(spark, rows)
    assert all([(s["kind"], s["owners"], s["repositories"], s["live"]) for s in got[i]] == [(3, 1, n, False), (0, 1, n, False)] for i in range(n))
    assert {r["text"].split(" has ")[1] for r in secrets.redact_secrets(spark.createDataFrame(rows, SCHEMA)).collect()} == {"[EXAMPLE] and [EXAMPLE]"}
    # As many exact copies are one text, and one text fewer is still live.
    assert all(s["live"] for spans in found(spark, [(i, rows[0][1], "hot") for i in range(n)]).values() for s in spans)
    assert all(s["live"] for spans in found(spark, rows[1:]).values() for s in spans)
