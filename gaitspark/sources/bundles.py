"""Bundles, each one document of bounded size with parts that are looked up one at a time.

A bundle's rows are (section, key, place, body), body a JSON text. Sections named as
parts go to sorted files of lines, written by all tasks; the others make up the
document, an object by section: the body itself where the key is null, else an object by key
of the bodies in the order of place. A write makes a new version:

    path/<version>/document.json
    path/<version>/<section>-<name>.jsonl
    path/<version>/manifest.json        what belongs to it; written last, and what makes it a version

A write that fails, or whose document is over its budget, takes its folder away, and
readers pass over folders without a manifest. Versions are named by the time of the writing driver.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import settled, share_package

SCHEMA = "section string, key string, place long, body string"
BUDGET = 25_000_000


def _store(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _constant(name: str):
    raise ValueError(f"no JSON: {name}")


def _value(body: str | None):
    return None if body is None else json.loads(body, parse_constant=_constant)


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@dataclass
class _Written(WriterCommitMessage):
    parts: list[dict] = field(default_factory=list)
    staged: str | None = None
    size: int = 0


class BundleWriter(DataSourceWriter):
    def __init__(self, path: str, parts: set[str], budget: int):
        self.parts, self.budget = parts, budget
        self.root = f"{path.rstrip('/')}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator: Iterator) -> _Written:
        store, root = _store(self.root)
        store.create_dir(root, recursive=True)
        out, document = _Written(), []
        for section, rows in groupby(iterator, lambda r: r["section"]):
            if section is None:
                raise ValueError("a row without section")
            if section in self.parts:
                out.parts.append(self._part(store, root, section, rows))
                continue
            for r in rows:
                line = _text([section, r["key"], r["place"], _value(r["body"])])
                out.size += len(line.encode()) + 1
                if out.size > self.budget:
                    raise ValueError(f"the document is over its budget of {self.budget} bytes")
                document.append(line)
        if document:
            out.staged = f"staged-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{root}/{out.staged}") as f:
                f.write("".join(f"{line}\n" for line in document).encode())
        return out

    @staticmethod
    def _part(store, root: str, section: str, rows: Iterator) -> dict:
        name, first, last, n = f"{section}-{uuid.uuid4().hex}.jsonl", None, None, 0
        with store.open_output_stream(f"{root}/{name}") as f:
            for r in rows:
                if r["key"] is None:
                    raise ValueError(f"a part of {section} without key")
                f.write(f"{_text([r['key'], r['place'], _value(r['body'])])}\n".encode())
                first, last, n = r["key"] if first is None else min(first, r["key"]), r["key"] if last is None else max(last, r["key"]), n + 1
        return {"section": section, "file": name, "first": first, "last": last, "rows": n}

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m is not None]
        if sum(m.size for m in done) > self.budget:
            raise ValueError(f"the document is over its budget of {self.budget} bytes")
        store, root = _store(self.root)
        store.create_dir(root, recursive=True)
        rows = []
        for m in done:
            if m.staged:
                with store.open_input_stream(f"{root}/{m.staged}") as f:
                    rows += [json.loads(line) for line in f.read().decode().split("\n") if line]
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0, _text(r[3])))
        document: dict = {}
        for section, key, _, value in rows:
            if key is not None and isinstance(document.setdefault(section, _Keyed()), _Keyed):
                document[section].setdefault(key, []).append(value)
            elif section in document:
                raise ValueError(f"section {section} has a value without key and others")
            else:
                document[section] = value
        parts = [p for m in done for p in m.parts]
        self._put(store, f"{root}/document.json", document)
        kept = {"document.json", *(p["file"] for p in parts)}
        for info in store.get_file_info(_listing(root)):
            if info.base_name not in kept:  # staged rows and what lost attempts wrote
                store.delete_file(info.path)
        keyed = sorted(s for s, v in document.items() if isinstance(v, _Keyed))
        self._put(store, f"{root}/manifest.json", {"parts": parts, "keyed": keyed})

    @staticmethod
    def _put(store, path: str, value) -> None:
        with store.open_output_stream(path) as f:
            f.write(_text(value).encode())

    def abort(self, messages: list) -> None:
        store, root = _store(self.root)
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(root)


class _Keyed(dict):
    """Bodies by key, other than a body that is an object itself."""


def _listing(root: str):
    from pyarrow import fs

    return fs.FileSelector(root, allow_not_found=True)


def versions(path: str) -> list[str]:
    """Whole versions, the newest first."""
    store, root = _store(path.rstrip("/"))
    names = sorted((i.base_name for i in store.get_file_info(_listing(root)) if i.base_name), reverse=True)
    return [n for n in names if store.get_file_info(f"{root}/{n}/manifest.json").is_file]


class BundleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.version = options["path"].rstrip("/"), options.get("version")
        self.section, self.key = options.get("section"), options.get("key")

    def _load(self, version: str, name: str):
        store, root = _store(f"{self.path}/{version}")
        with store.open_input_stream(f"{root}/{name}") as f:
            return json.loads(f.read())

    def partitions(self) -> list[InputPartition]:
        """The document, and the parts' files that can hold the section and key asked for."""
        version = self.version or next(iter(versions(self.path)), None)
        if version is None:
            return []
        manifest = self._load(version, "manifest.json")
        fits = lambda p: self.section in (None, p["section"]) and (self.key is None or p["first"] <= self.key <= p["last"])
        parts = [p for p in manifest["parts"] if fits(p)]
        document = self.section is None or all(p["section"] != self.section for p in manifest["parts"])
        return [InputPartition(("document.json", None, version, manifest["keyed"]))] * document + [InputPartition((p["file"], p["section"], version, None)) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # no version
            return
        name, section, version, keyed = partition.value
        wanted = lambda s, k: self.section in (None, s) and self.key in (None, k)
        if section is None:
            for s, value in self._load(version, name).items():
                for k, bodies in value.items() if s in keyed else [(None, [value])]:
                    if wanted(s, k):
                        yield from ((s, k, i, _text(v)) for i, v in enumerate(bodies))
            return
        store, root = _store(f"{self.path}/{version}")
        with store.open_input_stream(f"{root}/{name}") as f:
            for line in _lines(f):
                k, place, value = json.loads(line)
                if wanted(section, k):
                    yield section, k, place, _text(value)


def _lines(f) -> Iterator[bytes]:
    rest = b""
    while block := f.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class BundleSource(DataSource):
    """Format 'bundle'; options: path; to write parts (names, comma-joined) and budget; to read version, section and key."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BundleReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        parts = {p for p in self.options.get("parts", "").split(",") if p}
        return BundleWriter(self.options["path"], parts, int(self.options.get("budget", BUDGET)))


def _registered(spark: SparkSession) -> SparkSession:
    share_package(spark)
    spark.dataSource.register(BundleSource)
    return spark


def section(name: str, rows: DataFrame, key: str | None = None, place: str | None = None, body: Column | None = None) -> DataFrame:
    """rows as a section of a bundle; the body is an object of the other columns, nulls kept."""
    others = [c for c in rows.columns if c not in (key, place)]
    body = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if body is None else body
    at = lambda c, kind: (F.lit(None) if c is None else F.col(c)).cast(kind)
    return rows.select(F.lit(name).alias("section"), at(key, "string").alias("key"), at(place, "long").alias("place"), body.alias("body"))


def write_bundle(rows: DataFrame, path: str, parts: tuple[str, ...] = (), budget: int = BUDGET) -> None:
    """A new version of the bundle at path. Fails, and leaves nothing, where the document takes more than budget bytes.

    Rows are cut into ranges of (section, key, place), so neither a large section nor a
    key with many places is one task's. Bodies come back as equal JSON. Fails on a null section, a part
    without key, a body that is no JSON, and a section with both keyed and other bodies.
    """
    _registered(rows.sparkSession)
    order = ["section", "key", "place"]
    rows.select("section", "key", F.col("place").cast("long").alias("place"), "body").repartitionByRange(*order).sortWithinPartitions(*order).write.format("bundle").mode("append").options(path=path, parts=",".join(parts), budget=str(budget)).save()


def read_bundle(spark: SparkSession, path: str, section: str | None = None, key: str | None = None, version: str | None = None) -> DataFrame:
    """Rows of the newest version, or another; of one section or key only the files that can hold it are read. Nothing where there is no version."""
    asked = {n: v for n, v in (("section", section), ("key", key), ("version", version)) if v is not None}
    return _registered(spark).read.format("bundle").options(path=path, **asked).load()


def unpacked(rows: DataFrame, fields: str) -> DataFrame:
    """Rows of a section with their bodies' fields as columns."""
    return rows.select("key", "place", F.from_json("body", fields).alias("_b")).select("key", "place", "_b.*")


def save_frames(frames: dict[str, DataFrame], path: str, document: tuple[str, ...] = (), budget: int = BUDGET) -> None:
    """The frames of a result as a new version of a bundle, their rows looked up by their first column.

    Frames named in document, of equal rows in any order, go there as long as their measured size
    fits the budget, in the order named; what does not fit is kept as parts like all others, and nothing is cut.
    """
    spark = next(iter(frames.values())).sparkSession
    rows = None
    for name, frame in frames.items():
        one = section(name, frame.withColumn("_key", F.coalesce(F.col(frame.columns[0]).cast("string"), F.lit(""))), "_key", body=F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}))
        rows = one if rows is None else rows.unionByName(one)
    rows = settled(rows, "bundle")
    columns = spark.createDataFrame([("columns", n, 0, f.schema.json()) for n, f in frames.items()], SCHEMA)
    # Quotes, commas and the names around a row.
    sizes = rows.where(F.col("section").isin(*document)).groupBy("section").agg(F.sum(F.octet_length("body") + F.octet_length("key") + F.octet_length("section") + 40).alias("n"))
    size = {r["section"]: r["n"] for r in sizes.collect()}
    room, small = budget - sum(len(f.schema.json()) + 100 for f in frames.values()), []
    for name in document:
        if size.get(name, 0) <= room:
            room -= size.get(name, 0)
            small.append(name)
    write_bundle(rows.unionByName(columns), path, tuple(n for n in frames if n not in small), budget)


def load_frames(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """What save_frames() was given, with its types; each frame reads its own section. Empty where there is no version."""
    found = {r["key"]: T.StructType.fromJson(json.loads(r["body"])) for r in read_bundle(spark, path, "columns", version=version).collect()}
    return {n: read_bundle(spark, path, n, version=version).select(F.from_json("body", kind).alias("_b")).select("_b.*") for n, kind in found.items()}
