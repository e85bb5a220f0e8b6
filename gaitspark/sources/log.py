"""K3, K4, S2, T-8: an annotation log whose appends are ordered by commits.

An append writes its records to a folder of its own, each with the part that wrote it
and its place there, and then makes a commit: a small file, named by the next number, that gives
the append its range of sequence numbers and each part its place in the range. A
commit file is made only where none is, so of two appends at once one takes the
next number and the other tries the one after. Readers see committed appends alone,
so an append that fails leaves nothing.

    log/_commits/00000000000000000000.json
    log/_appends/<name>/part-...
    log/*.json                              lines written before there were commits
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.labels import validated
from ..schema import ANNOTATION

_FIELDS = [f for f in ANNOTATION.fields if f.name != "seq"]
_RECORD = T.StructType([*_FIELDS, T.StructField("seq", T.LongType())])
_STORED = T.StructType([*_FIELDS, T.StructField("_part", T.IntegerType()), T.StructField("_nth", T.LongType())])
_PART_BITS = 33  # of monotonically_increasing_id, which puts a row's place in its part there


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def _root(spark: SparkSession, path: str) -> str:
    """The folder that commits are kept in: the log itself, or one beside it where the log is a file."""
    fs, where = _fs(spark, path)
    return f"{path}.d" if fs.exists(where) and fs.getFileStatus(where).isFile() else path


def _commit_names(spark: SparkSession, root: str) -> list[str]:
    fs, where = _fs(spark, f"{root}/_commits")
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file, unless there is one."""
    fs, where = _fs(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or fs.exists(where):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _commits(spark: SparkSession, root: str) -> DataFrame:
    """(name, number, start, n, offsets) of every commit; offsets: each part's place in the range."""
    schema = "name string, number long, start long, n long, offsets map<string, long>"
    return spark.read.schema(schema).json(f"{root}/_commits/*.json") if _commit_names(spark, root) else spark.createDataFrame([], schema)


def _old_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """Records of lines without commits, with seq.

    Lines that carry a seq of their own come in its order, behind those that carry none;
    these come in the order of their files' times and names, and of their places. A line is numbered by
    where its file and its split begin and its place in the split: it has fewer lines than
    bytes, so numbers never meet, and a log of any size is read in parallel.
    """
    if not exists(spark, path):
        return None
    fs, where = _fs(spark, path)
    if not fs.getFileStatus(where).isFile() and all(s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(where)):
        return None
    meta = {"file": "file_path", "start": "file_block_start", "size": "file_size", "time": "file_modification_time"}
    lines = spark.read.text(path).select("value", *[F.col(f"_metadata.{c}").alias(n) for n, c in meta.items()], F.monotonically_increasing_id().alias("at"))
    before = W.orderBy("time", "file").rowsBetween(W.unboundedPreceding, -1)
    # One row for each file.
    files = lines.select("file", "size", "time").distinct().withColumns({"base": F.coalesce(F.sum("size").over(before), F.lit(0)), "all": F.sum("size").over(W.partitionBy())})
    place = F.col("start") + F.row_number().over(W.partitionBy("file", "start").orderBy("at")) - 1
    rows = lines.where("trim(value) <> ''").select(F.from_json("value", _RECORD).alias("r"), place.alias("pos"), "file").join(F.broadcast(files.select("file", "base", "all")), "file")
    seq = F.coalesce(F.col("r.seq") + F.col("all"), F.col("base") + F.col("pos"))
    return rows.select(*[f"r.{f.name}" for f in _FIELDS], seq.alias("seq")).where("episode_id is not null")


def read_annotation_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of a log, a folder or one file of JSON lines, with seq, their order. A missing log gives no rows."""
    out = spark.createDataFrame([], _RECORD)
    old, root = _old_lines(spark, path), _root(spark, path)
    out = out if old is None else out.unionByName(old)
    if not _commit_names(spark, root):
        return out
    rows = spark.read.schema(_STORED).json(f"{root}/_appends/*").withColumn("name", F.regexp_extract(F.input_file_name(), r"_appends/([^/]+)/", 1))
    seq = F.col("start") + F.element_at("offsets", F.col("_part").cast("string")) + F.col("_nth")
    return out.unionByName(rows.join(F.broadcast(_commits(spark, root)), "name").select(*[f.name for f in _FIELDS], seq.alias("seq")))


def append_annotations(records: DataFrame, path: str) -> tuple[int, int] | None:
    """K3, K4: adds records, all or none, and gives them the next sequence numbers; returns (first, behind the last).

    Records are checked against the vocabulary first. They keep the order of the frame, or
    of its column seq if it has one (null first), which orders this append alone: a later append is
    always behind it. No records leave the log as it is.
    """
    spark = records.sparkSession
    rows = validated(records)
    if "seq" in rows.columns:
        rows = rows.repartitionByRange("seq").sortWithinPartitions("seq").drop("seq")
    root, name = _root(spark, path), uuid.uuid4().hex
    at = F.monotonically_increasing_id()
    numbered = rows.withColumns({"_part": F.shiftrightunsigned(at, _PART_BITS).cast("int"), "_nth": at.bitwiseAND(F.lit((1 << _PART_BITS) - 1))})
    numbered.write.json(f"{root}/_appends/{name}")
    parts = spark.read.schema(_STORED).json(f"{root}/_appends/{name}").groupBy("_part").agg((F.max("_nth") + 1).alias("n")).collect()  # a row for each part
    offsets, n = {}, 0
    for r in sorted(parts):
        offsets[r["_part"]], n = n, n + r["n"]
    if not n:
        return None
    while True:
        names = _commit_names(spark, root)
        if names:
            number, start = _commits(spark, root).agg(F.max("number") + 1, F.max(F.col("start") + F.col("n"))).first()
        else:
            old = _old_lines(spark, path)
            number, start = 0, (0 if old is None else (old.agg(F.max("seq")).first()[0] or 0) + 1)
        commit = {"name": name, "number": number, "start": start, "n": n, "offsets": offsets}
        if _create(spark, f"{root}/_commits/{number:020d}.json", json.dumps(commit)):
            return start, start + n
