"""Queries of operators 11 to 13, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, licenses, tries


def op11_family_first_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tries.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256"))


def op13_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.col("places.label")
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("places.n", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_base"),
        F.array_min("places.first").alias("first_word"),
        F.array_max("places.last").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("notices.label"))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("notices.containment"), F.lit(0.0))).alias("score"),
    )


QUERIES = {f.__name__: f for f in (op11_family_first_trie, op12_annular_codes, op13_license_notices)}

# A byte at a time: the low bit is shifted out eight times.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i::INT, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::BIGINT)), lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"""
_OP11 = rf"""
WITH turns AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) AS t, c - c % 20 AS base, c::VARCHAR AS name FROM turns GROUP BY c),
taken AS (SELECT *, ({_CRC.format("name")} % 4)::INT AS h FROM own),
rebuilt AS (SELECT k.c, list_concat(coalesce(b.t[1:k.h], []), k.t[k.h + 1:]) AS t FROM taken k LEFT JOIN own b ON b.c = k.base),
paths AS (SELECT c, len(t) AS size, unnest(range(0, len(t) + 1)) AS depth, t FROM rebuilt),
seen AS (SELECT c, depth, t[1:depth::INT] AS path, depth = size AS final FROM paths),
nodes AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, list(c ORDER BY c) FILTER (WHERE final) AS ends FROM seen GROUP BY path, depth),
worth AS (SELECT *, coalesce((n_convs - 1) * len(regexp_extract_all(path[-1].text, '[^\x20\x09-\x0D]+')), 0) AS saved, path[1:(depth - 1)::INT] AS up FROM nodes),
kids AS (SELECT up AS path, count(*) AS n_children FROM worth WHERE depth > 0 GROUP BY up),
counted AS (SELECT w.*, coalesce(n_children, 0) AS n_children FROM worth w LEFT JOIN kids k ON w.path = k.path),
spread AS (SELECT path[1:d::INT] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY 1)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
  sha256(coalesce(array_to_string(c.ends, ','), '')) AS ends_sha256
FROM counted c JOIN spread s ON s.path = c.path LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.up AND p.depth = c.depth - 1
"""


def _op12_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT r, p, v[(p * len(v) // {parts} + 1)::INT:((p + 1) * len(v) // {parts})::INT] AS x FROM kept, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, r AS e, x AS y FROM cut WHERE r < {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""d{i} AS (SELECT r, c.p, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut c JOIN b{i} b ON c.p = b.p),
a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{i} GROUP BY r, p)"""
        )
        if i < rounds:
            steps.append(
                f"""s{i} AS (SELECT a.p, e, j, floor(sum(x[j::INT])::HUGEINT / count(*))::BIGINT AS m FROM a{i} a JOIN cut c ON a.r = c.r AND a.p = c.p, unnest(range(1, len(x) + 1)) AS u(j) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(any_value(n.y), any_value(b.y)) AS y FROM b{i} b LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS y FROM s{i} GROUP BY ALL) n ON b.p = n.p AND b.e = n.e GROUP BY ALL)"""
            )
    return f"""
WITH {", ".join(steps)},
coded AS (SELECT r, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _op13_sql() -> str:
    templates = licenses.templates_of(licenses.TEMPLATES, 80)
    above = {t.number: [b for a, b in licenses.covers(templates) if a == t.number] for t in templates}
    values = ", ".join(f"({t.number}, '{t.label}', {t.stride}, {t.need}, {_quoted(t.words)}, {_quoted(t.names)}, {above[t.number]}::INT[])" for t in templates)
    strides = sorted({t.stride for t in templates})
    phrases = ", ".join(f"('{label}', '{phrase}', {len(phrase.split())})" for phrase, label in licenses.PHRASES)
    separators = licenses.SEPARATORS
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{separators}'), lambda x: x <> '') AS ws FROM documents),
phrases(label, phrase, k) AS (VALUES {phrases}),
likely AS (SELECT * FROM d WHERE list_has_any(ws, ['license', 'cc'])),
spots AS (SELECT r, label, phrase, k, i FROM (SELECT r, label, phrase, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM likely, phrases) WHERE array_to_string(ws[i::INT:(i + k - 1)::INT], ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels FROM spots GROUP BY r),
templates(t, label, stride, need, words, names, above) AS (VALUES {values}),
windows AS (SELECT r, stride, list_distinct(ws[(w * stride + 1)::INT:((w + 2) * stride)::INT]) AS block, w
  FROM (SELECT r, stride, ws, unnest(range(0, (len(ws) - 1) // stride + 1)) AS w FROM d, (SELECT unnest({strides}) AS stride) WHERE len(ws) > 0)),
met AS (SELECT r, m.stride, w, t, label, above, len(list_intersect(block, words)) AS shared, len(words) AS size FROM windows m JOIN templates t ON m.stride = t.stride
  WHERE list_has_all(block, names) AND len(list_intersect(block, words)) >= need),
held AS (SELECT *, list(t) OVER (PARTITION BY r, stride, w) AS every FROM met),
notices AS (SELECT r, list(DISTINCT label) AS labels, max(shared / size) AS best FROM held WHERE NOT list_has_any(every, above) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(n.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base b USING (r) LEFT JOIN notices n USING (r)
"""


ORACLE_SQL = {"op11_family_first_trie": _OP11, "op12_annular_codes": _op12_sql(), "op13_license_notices": _op13_sql()}
