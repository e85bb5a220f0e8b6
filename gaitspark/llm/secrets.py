"""Secret scan with corpus-wide ownership frequency.

Base patterns find credentials by their form. Loose candidates, long mixed tokens
without such a form, count only by who has them: a value that few owners have looks
owner-specific, one that many owners share, or many repositories with texts of their
own, is an example that is copied around. The same counts mark the base finds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join, worker_path

# The base patterns, the least length of what counts, the order of kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "owned")

LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
WIDE = 3  # owners from which on a value is a copied example
SPREAD = 100  # repositories with different texts from which on it is one even with fewer owners


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind's place, value) of the base patterns, leftmost and non-overlapping in each kind."""
    out = [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def loose_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens of letters in both cases with digits and high entropy, outside the base spans."""
    out = []
    for m in LOOSE.finditer(text):
        v = m[0]
        if re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v) and entropy(v) >= 3.5 and not any(s < m.end() and m.start() < e for s, e, *_ in base):
            out.append((m.start(), m.end(), 3, v))
    return out


def span_text(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, *_ in spans)


SPAN = "struct<start:int,end:int,kind:int,value_hash:long>"


def _scan(names: list[str]):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value_hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            found, uids = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                found.append([{"start": s, "end": e, "kind": k, "value_hash": xxhash.xxh64_intdigest(v) - 2**63} for s, e, k, v in base + loose_spans(text or "", base)])
                uids.append(uid)
                uid += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(uids, pa.int64()), pa.array(found, kind)], [*names, "_uid", "_found"])

    return run


def scan_secrets(docs: DataFrame, owner: str = "source", keep: tuple[str, ...] = ("doc_id",), repository: str = "doc_id") -> DataFrame:
    """The columns ``keep`` of docs with found: an array of (start, end, kind, owners, repositories, live), by start, then kind.

    kind indexes KINDS. owners and repositories count the distinct values of those
    columns, over the whole corpus, whose documents hold the same secret value; a
    missing column or null value counts as one unknown owner. live: fewer than three
    owners and fewer than a hundred repositories; of repositories with the same text,
    mirrors of one another, one counts here. Spans of
    the kind "owned" are loose candidates of fewer than three owners; those of more
    owners are left out, base spans always stay. Offsets are code points, ends
    exclusive. A null text is empty. Every row of docs gives one row, repeated ones too.
    """
    worker_path(docs.sparkSession)
    names = list(dict.fromkeys([*keep, "text", *(c for c in (owner, repository) if c in docs.columns)]))
    docs = docs.select(*[docs[n] for n in names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    scanned = docs.mapInArrow(_scan(names), f"{kinds}, _uid long, _found array<{SPAN}>")
    who = {"_owner": F.coalesce(F.col(owner).cast("string"), F.lit("")) if owner in names else F.lit(""), "_repo": F.coalesce(F.col(repository).cast("string"), F.lit("")) if repository in names else F.lit("")}
    scanned = materialize(scanned.withColumns(who | {"_text": F.xxhash64("text")}).select(*keep, "_uid", "_found", "_owner", "_repo", "_text"), "secrets")
    hits = scanned.where(F.size("_found") > 0)
    each = hits.select("_uid", "_owner", "_repo", "_text", F.explode("_found").alias("s"))
    each = each.withColumn("h", F.col("s.value_hash"))
    # Each count is summed up twice, so that a value in a third of all rows is no hot key.
    distinct = lambda c, name: each.groupBy("h", c).agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias(name), F.sum("n").alias("n"))
    values = distinct("_owner", "owners").join(distinct("_repo", "repositories").drop("n"), "h").join(distinct("_text", "texts").drop("n"), "h")
    values = materialize(values, "values")
    total = values.agg(F.sum("n")).first()[0] or 0
    known = spread_join(each.select("_uid", "s", "h"), values, "h", "n", total)
    known = known.where((F.col("s.kind") < 3) | (F.col("owners") < WIDE))
    one = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), "owners", "repositories", ((F.col("owners") < WIDE) & (F.col("texts") < SPREAD)).alias("live"))
    spans = known.groupBy("_uid").agg(F.sort_array(F.collect_list(one)).alias("found"))
    none = spans.schema["found"].dataType
    without = scanned.where(F.size("_found") == 0).select(*keep, F.array().cast(none).alias("found"))
    return hits.select(*keep, "_uid").join(spans, "_uid", "left").select(*keep, F.coalesce("found", F.array().cast(none)).alias("found")).unionByName(without)


def redact(text: str | None, found: list[dict]) -> str | None:
    """text with every live span as [SECRET] and every copied example as [EXAMPLE]; overlapping spans become one mark."""
    if not found or not text:
        return text
    spans: list[list] = []
    for s in sorted(found, key=lambda x: (x["start"], -x["end"])):
        if spans and s["start"] < spans[-1][1]:
            spans[-1][1], spans[-1][2] = max(spans[-1][1], s["end"]), spans[-1][2] or s["live"]
        else:
            spans.append([s["start"], s["end"], s["live"]])
    out, at = [], 0
    for a, b, live in spans:
        out += [text[at:a], "[SECRET]" if live else "[EXAMPLE]"]
        at = b
    return "".join([*out, text[at:]])


def _redact(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [redact(t, f) for t, f in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    return run


def redact_secrets(docs: DataFrame, owner: str = "source") -> DataFrame:
    """docs with its secrets replaced in text; n_chars follows where that column exists. No row is dropped."""
    rest = [c for c in docs.columns if c != "text"]
    fields = {f.name: f.dataType for f in docs.schema.fields}
    packed = docs.select("text", F.struct(*[docs[c] for c in rest]).alias("_rest"), *([docs[owner].alias("_owned_by")] if owner in rest else []), *([docs["doc_id"].alias("_held_in")] if "doc_id" in rest else []))
    found = scan_secrets(packed, "_owned_by", ("text", "_rest"), "_held_in")
    hit = found.where(F.size("found") > 0).mapInArrow(_redact(["text", "_rest"]), f"text string, _rest {packed.schema['_rest'].dataType.simpleString()}")
    hit = hit.select(*[F.col("text") if c == "text" else F.length("text").cast(fields[c]).alias(c) if c == "n_chars" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
    clean = found.where(F.size("found") == 0).select(*[F.col("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
    return clean.unionByName(hit)
