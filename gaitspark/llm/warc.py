"""WARC archives: writing captures with revisit records, reading, transaction assembly.

A capture is written as three records: the response (or a revisit of an earlier one
with an equal payload), the request and metadata, the latter two concurrent to the
first. Archives go through Spark's text writer, whose line separator is the end of
a WARC record, so any file system that Spark writes to will do. They are parsed by
Content-Length, never by looking for a separator, and records are joined again
through their concurrent-to identifiers. Compressed archives are read as a stream, so
a task holds one record, however long the file is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, spread_join, worker_path

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of the UTF-8 bytes: 20 bits at a time from the hexadecimal digest."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), rid, F.lit(f">\r\nWARC-Date: {DATE}\r\n")]
    for name, value in headers:
        lines.append(F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _line(value: Column) -> Column:
    """A header's value: one line without control characters; null stays null."""
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]", " ")


def write_archives(pages: DataFrame, path: str, least: int = 0, records_in_file: int = 100_000) -> None:
    """Write the captures of pages (page_id, url, html) as WARC files under path.

    Pages with payloads of equal SHA-1 and at least ``least`` bytes share one response,
    that of the smallest page_id; the others are revisits that refer to it. Repeated
    rows of the smallest page_id are responses, too, each under an id of its own, of
    which revisits name the first. A null html is an empty payload, a null page_id comes last and
    is written as an empty field, a null url leaves the target out. Files hold at most
    records_in_file records.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), _line(F.col("url")).alias("url"), html.alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", payload_digest(F.col("html"))).withColumn("uid", F.expr("uuid()"))
    order = F.coalesce(F.col("page_id"), F.lit(2**63 - 1))
    alike = lambda t: t.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(F.struct(order.alias("first"), "uid")).alias("one"), F.count("*").alias("copies"), F.count_distinct(order).alias("pages")).where("copies > 1")
    shared = materialize(alike(rows), "digests")
    if shared.where("copies > pages").take(1):
        # Rows are repeated: their random ids must hold for good, so that one of them can be named.
        rows = materialize(rows, "captures")
        shared = materialize(alike(rows), "digests", replaces=shared)
        chosen = F.col("uid") == F.col("one.uid")
    else:
        chosen = F.lit(True)
    total = shared.agg(F.sum("copies")).first()[0] or 0
    rows = spread_join(rows, shared.select("digest", "one", "copies"), "digest", "copies", total, "left")
    rows = rows.withColumn("first", F.col("one.first")).withColumn("is_first", F.col("first").isNull() | (order == F.col("first")))
    # A response that others refer to is named after its payload and page; the others' names are random.
    named = F.concat(F.lit("urn:capture:"), F.col("digest"), F.lit(":"), F.col("first").cast("string"))
    own = F.when(F.col("first").isNotNull() & F.col("is_first") & chosen, named).otherwise(F.concat(F.lit("urn:uuid:"), F.col("uid")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    target = ("WARC-Target-URI", F.col("url"))
    block_type = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", own, [target, digest, block_type], F.concat(http, F.col("html")))
    revisit = _record("revisit", own, [target, digest, block_type, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.concat(F.lit("<"), named, F.lit(">")))], http)
    to = ("WARC-Concurrent-To", F.concat(F.lit("<"), own, F.lit(">")))
    place = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    request = _record("request", F.concat(own, F.lit("-q")), [target, to, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(" HTTP/1.1"), F.lit(END)))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayload-bytes: "), F.col("bytes").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", F.concat(own, F.lit("-m")), [target, to, ("Content-Type", F.lit("application/warc-fields"))], fields)
    records = rows.select(F.explode(F.array(F.when(F.col("is_first"), response).otherwise(revisit), request, metadata)).alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", records_in_file).option("compression", "gzip").text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive; raises ValueError where it isn't one."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        at = start + int(headers["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record of {headers['content-length']} bytes isn't ended at byte {at}")
        yield headers, data[start:at]
        at += 4


FIELDS = ["record_id", "type", "target_uri", "date", "concurrent_to", "refers_to", "stated_digest", "payload_digest", "block_bytes", "block"]
KINDS = {"block_bytes": ("long", pa.int64()), "block": ("binary", pa.binary())}
#: Records and bytes that a task hands on at once.
ROWS, BYTES = 256, 8 << 20


def _row(h: dict[str, str], block: bytes) -> tuple:
    kind = h.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in h.get("content-type", "") else block
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None
    strip = lambda k: h[k].strip("<>") if k in h else None
    return (strip("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), strip("warc-concurrent-to"), strip("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, own, len(payload), payload)


def _batches(records: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[] for _ in FIELDS]
    held = 0
    for h, block in records:
        for c, x in zip(cols, _row(h, block), strict=True):
            c.append(x)
        held += len(block)
        if len(cols[0]) >= ROWS or held > BYTES:
            yield _batch(cols)
            cols, held = [[] for _ in FIELDS], 0
    yield _batch(cols)


def joined_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of archives that come cut at every empty line, which blocks may hold, too; one record is held at a time.

    Raises ValueError where Content-Length doesn't lead to the end of a record.
    """
    end, held = END.encode(), bytearray()

    def more() -> None:
        piece = next(pieces, None)
        if piece is None:
            raise ValueError(f"an archive ends within a record: {bytes(held[:60])!r}")
        held.extend(piece)
        held.extend(end)

    while True:
        # A last line end within a block is taken for one of the two behind it, so more of them may stand between records.
        while held[:2] == b"\r\n":
            del held[:2]
        if not held:
            piece = next(pieces, None)
            if piece is None:
                return
            held.extend(piece)
            held.extend(end)
            continue
        head = held.find(end)
        lines = held[:head].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {bytes(held[:60])!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = head + 4 + int(headers["content-length"])
        while len(held) < stop + 4:
            more()
        if held[stop : stop + 4] != end:
            raise ValueError(f"record of {headers['content-length']} bytes isn't ended there")
        yield headers, bytes(held[head + 4 : stop])
        del held[: stop + 4]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            yield from _batches(parse_records(content.as_py()))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(joined_records(x for batch in batches for x in batch.column("value").to_pylist()))


def _batch(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS.get(f, ("", pa.string()))[1]) for f, c in zip(FIELDS, cols, strict=True)], FIELDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ids, type, target, date, stated digest, and for responses the payload and its own digest.

    Files that end in .gz are read as streams, the unit that Spark cannot split. Plain archives (.warc)
    are read whole, so each must be smaller than 2 GB.
    """
    worker_path(spark)
    kinds = ", ".join(f"{f} {KINDS.get(f, ('string',))[0]}" for f in FIELDS)
    lines = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary").alias("value"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select("content")
    return lines.mapInArrow(_stream, kinds).union(plain.mapInArrow(_parse, kinds))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (response or revisit), request, metadata.

    Requests and metadata are joined through concurrent_to; of several the one with
    the smallest id is taken, and a capture without one has null there. Records of
    other types, and those concurrent to nothing that is there, are left out.
    """
    captures = records.where("type in ('response', 'revisit')").select("record_id", F.struct(*[F.col(f) for f in FIELDS]).alias("capture"))
    out = captures
    for kind in ("request", "metadata"):
        side = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        side = side.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct("record_id", "target_uri", "date", "block")).alias(kind))
        out = out.join(side, "record_id", "left")
    return out.drop("record_id")


def resolve(captures: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """captures, a written table, with columns of the response that a revisit refers to by WARC-Refers-To; null for others.

    columns: the new names and what they are of the response's row. A response that
    a third of all captures refer to is no hot key.
    """
    referred = captures.where("capture.refers_to is not null").groupBy(F.col("capture.refers_to").alias("_to")).agg(F.count("*").alias("_n"))
    found = captures.where("capture.type = 'response'").select(F.col("capture.record_id").alias("_to"), *[c.alias(n) for n, c in columns.items()])
    found = found.dropDuplicates(["_to"]).join(referred, "_to")
    total = captures.where("capture.refers_to is not null").count()
    return spread_join(captures.withColumn("_to", F.col("capture.refers_to")), found, "_to", "_n", total, "left").drop("_to")


def field(name: str) -> Column:
    """A field of the metadata record's block; null where it is empty."""
    return F.nullif(F.regexp_extract(F.decode("metadata.block", "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
