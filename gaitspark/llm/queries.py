"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ann, fingerprints, later_queries, neardup, packing, quality, secrets, spiece, toxicity, urls, warc
from .common import materialize, new_folder

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "nth", "part")
    return packing.pack(pieces, 1024, numbered=True)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, down = fingerprints.in_order(table(spark, sf_dir, "documents"))
    rows = rows.withColumns({"_row": F.row_number().over(down), "edited": fingerprints.edited(F.col("text"), F.coalesce(F.lead("text").over(down), F.lit("")))})
    # Text and edited text as rows of their own; all that follows stays where the order has put it.
    sides = rows.withColumn("side", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("text").alias("t")), F.struct(F.lit(1).alias("n"), F.col("edited").alias("t")))))
    sides = sides.select("_bucket", "_row", "_guest", "doc_id", F.col("side.n").alias("side"), F.length("side.t").cast("long").alias("n"), F.when(F.col("side.n") == 1, F.sha2(F.col("side.t").cast("binary"), 256)).alias("sha"), F.col("side.t").alias("t"))
    both = fingerprints.fingerprint(sides, ["_bucket", "_row", "_guest", "doc_id", "side", "n", "sha"], "t", "fp")
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    rows = both.groupBy("_bucket", "_row", "_guest", "doc_id").agg(of(0, "n").alias("n_chars"), of(1, "sha").alias("edited_sha256"), of(0, "fp").alias("own"), of(1, "fp").alias("other"))
    rows = rows.withColumn("after", F.lead("own").over(W.partitionBy("_bucket").orderBy("_row"))).where("_guest = 0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text(F.col("own")).alias("fingerprint"), fingerprints.as_text(F.col("other")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("own"), F.col("other")).alias("near_edited"), fingerprints.likeness(F.col("own"), F.col("after")).alias("near_next"),
    )


def op3_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 100 = 0"), 10)


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    # What follows needs no payloads, so they stay out of the joins; the archives are parsed once.
    light = F.when(~F.col("type").isin("response", "revisit"), F.col("block"))
    records = materialize(warc.read_archives(spark, path).withColumn("block", light), "records")
    captures = materialize(warc.assemble(records), "captures")
    captures = warc.resolve(captures, {"refers_to": warc.field("page-id").cast("long")})
    number = warc.field("payload-bytes").cast("long")
    return captures.select(
        warc.field("page-id").cast("long").alias("page_id"),
        F.when(F.col("capture.type") == "response", F.col("capture.block_bytes")).otherwise(number).alias("payload_bytes"),
        F.coalesce("capture.payload_digest", "capture.stated_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        "refers_to",
    )


def op6_marked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_BPE)
    decoded = spiece.decode_pieces(spiece.encode_pieces(table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in secrets.KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op8_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = quality.fit_quality(docs, labels.where(~held("doc_id")))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", "severity", "toxic_probability", "toxic")


def op10_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, miss=1e-6)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_order_minhash, op3_redirect_equivalence, op4_balanced_posting_lists, op5_warc_transactions,
        op6_marked_words, op7_secret_ownership, op8_naive_bayes_svm, op9_ordinal_toxicity, op10_min_max_hashing, pipeline,
    )
} | later_queries.QUERIES

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _parts_sql(url: str) -> tuple[str, str, str, str]:
    """scheme, host, path, address of a url that has ://."""
    rest = f"substr({url}, instr({url}, '://') + 3)"
    scheme, host = f"substr({url}, 1, instr({url}, '://') - 1)", _LOWER.format(f"regexp_extract({rest}, '^[^/?#]*')")
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return scheme, host, path, f"{_LOWER.format(scheme)} || '://' || {host} || {path} || coalesce(regexp_extract({rest}, '^[^?#]*(\\?[^#]*)?', 1), '')"


def _attribute_sql(tag: str, name: str) -> str:
    found = rf"""regexp_extract({tag}, '(?is)[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""
    bare = rf"""CASE WHEN {found}[1] IN ('"', '''') THEN {found}[2:-2] ELSE {found} END"""
    return rf"nullif(trim(replace(regexp_replace({bare}, '[\t\r\n\f]', ' ', 'g'), '&amp;', '&')), '')"


def _resolved_sql(source: str, base: str, link: str, out: str, name: str) -> str:
    """Expressions that end in ``name``: the rows of source with ``out``, the link resolved against base."""
    scheme, host, path, address = _parts_sql(base)
    return rf"""{name}_a AS (SELECT *, {scheme} AS scheme_, {host} AS host_, {path} AS path_, {address} AS address_ FROM {source}),
{name}_b AS (SELECT *, CASE WHEN {link} LIKE '/%' THEN '' WHEN contains(path_, '/') THEN regexp_extract(path_, '(?s)^.*/') ELSE '/' END || regexp_extract({link}, '^[^?#]*') AS to_ FROM {name}_a),
{name}_c AS (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(to_, '/')[2:], lambda x: [x])), lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] ELSE list_concat(a, x) END)
  AS kept_ FROM {name}_b),
{name} AS (SELECT * EXCLUDE (scheme_, host_, path_, address_, to_, kept_), CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link} WHEN {link} LIKE '//%' THEN scheme_ || ':' || {link}
  WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN {link} LIKE '#%' THEN address_ WHEN {link} LIKE '?%' THEN scheme_ || '://' || host_ || path_ || {link}
  ELSE scheme_ || '://' || host_ || '/' || array_to_string(CASE WHEN string_split(to_, '/')[-1] IN ('.', '..') THEN list_append(kept_, '') ELSE kept_ END, '/') || regexp_extract({link}, '(?s)^[^?#]*(.*)$', 1) END AS {out} FROM {name}_c)"""


_URL, _WHOLE, _NODE = _parts_sql("url"), _parts_sql("whole"), _parts_sql("b")
_OP3 = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, instr(coalesce(url, ''), '://') AS spot FROM pages),
addressed AS (SELECT *, CASE WHEN spot > 0 THEN {_URL[1]} ELSE '' END AS host, CASE WHEN spot > 0 THEN {_URL[2]} ELSE '' END AS path, CASE WHEN spot > 0 THEN {_URL[3]} END AS address FROM p),
rules(verdict, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
linking AS (SELECT url, html FROM p WHERE spot > 0 AND regexp_matches(html, '(?i)canonical|http-equiv')),
tokens AS (SELECT url, list_filter(regexp_extract_all(html, '{urls.tag_pattern("''")}', 1), lambda t: t <> '') AS every FROM linking),
tags AS (SELECT url, list_filter(list_transform(list_filter(every, lambda t: regexp_matches(t, '(?i)^<base')), lambda t: {_attribute_sql("t", "href")}), lambda h: h IS NOT NULL)[1] AS base, unnest(list_filter(every, lambda t: NOT regexp_matches(t, '(?i)^<base'))) AS tag FROM tokens),
named AS (SELECT url, base, CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches({_attribute_sql("tag", "rel")}, '(?i)(^|\s)canonical(\s|$)') THEN {_attribute_sql("tag", "href")}
  WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches({_attribute_sql("tag", "http-equiv")}, '(?i)^refresh$') THEN trim(regexp_extract({_attribute_sql("tag", "content")}, '(?is)(?:^|[;,\s])url\s*=\s*["'']?([^"'']*)', 1)) END AS link FROM tags),
wanted AS (SELECT * FROM named WHERE link <> ''),
{_resolved_sql("wanted", "url", "base", "start_", "based")},
started AS (SELECT url, link, CASE WHEN contains(start_, '://') THEN start_ ELSE url END AS start FROM based),
{_resolved_sql("started", "start", "link", "whole", "resolved")},
edges AS (SELECT {_URL[3]} AS u, CASE WHEN contains(whole, '://') THEN {_WHOLE[3]} END AS v FROM resolved),
links AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach AS (SELECT u AS a, u AS b FROM links UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u),
nodes AS (SELECT DISTINCT b, {_NODE[1]} AS host, {_NODE[2]} AS path FROM reach),
node_fit AS (SELECT b, arg_max(verdict, length(rule)) AS verdict FROM nodes JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY b),
alias AS (SELECT a AS address, bool_or(verdict = 'allow') AS ok FROM reach JOIN node_fit USING (b) GROUP BY a),
hosts AS (SELECT DISTINCT host, path FROM addressed),
fit AS (SELECT host, path, arg_max(verdict, length(rule)) AS verdict, arg_max(rule, length(rule)) AS rule FROM hosts JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, d.host, d.path, rule, coalesce(verdict, CASE WHEN coalesce(ok, true) THEN 'allow' ELSE 'block' END) AS verdict
FROM addressed d LEFT JOIN fit ON d.host = fit.host AND d.path = fit.path LEFT JOIN alias ON alias.address = d.address
"""

_OP5 = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hexed) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hexed, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""

_OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

ORACLE_SQL = {"op3_redirect_equivalence": _OP3, "op5_warc_transactions": _OP5, "op10_min_max_hashing": _OP10} | later_queries.ORACLE_SQL
