"""What the training-data operators share: shared storage, worker paths, row keys."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
_WRITTEN: list[tuple[SparkSession, str]] = []


_TABLE: dict = {}


def worker_table(make, *key):
    """The one large table a worker keeps between tasks: make(*key), made anew when another one is asked for."""
    if (make, *key) not in _TABLE:
        _TABLE.clear()
        _TABLE[make, *key] = make(*key)
    return _TABLE[make, *key]


def worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package even where the driver found it by sys.path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = ":".join([_ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session, whose driver is its only executor, gets a
    temporary folder; a cluster without a shared folder is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/gaitspark-shared-{os.getuid()}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody uses yet; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                remove_folder(spark, path)
        except Exception:  # the JVM may be gone by now
            return


atexit.register(_clean)


def materialize(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back.

    ``replaces``: a frame an earlier call returned and that nothing needs any more; its files go.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    if replaces is not None:
        release(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the files of a frame that materialize() returned."""
    path = getattr(df, "_shared_path", None)
    if path:
        remove_folder(df.sparkSession, path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


#: A key with more than this share of all rows is heavy, so there are at most a thousand heavy keys.
HEAVY = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right (one row for each key) so that no key's rows meet in one task.

    right's column ``count`` has the number of left rows of the key, of ``total`` in
    all. Keys with more than a thousandth of the rows, a thousand of them at most, are
    broadcast and their rows stay where they are; the others are shuffled. The count
    is left out of the result. how: inner or left. left is read twice, so it should be a written table.
    """
    limit = max(total // HEAVY, 256)
    heavy = F.broadcast(right.where(F.col(count) > limit).drop(count))
    light = right.where(F.col(count) <= limit).drop(count)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return left.join(heavy, key).unionByName(rest)


MARKS = 1 << 23


def marked(rows: DataFrame, key: Column, keys: DataFrame, column: Column) -> DataFrame:
    """rows with the boolean _marked: false only where key is surely not among the values of column in keys.

    A bitmap of 1 MB, whatever the number of keys, goes to every task in one broadcast
    row, so that the rows of most other keys need no shuffle. Null keys are unmarked.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    words = keys.select(place(column).alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    every = rows.sparkSession.range(MARKS // 64, numPartitions=1).withColumnRenamed("id", "w").join(words, "w", "left")
    bits = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]).alias("_bits"))
    at = place(key)
    bit = F.expr("shiftright(get(_bits, cast(_at div 64 as int)), cast(_at % 64 as int)) & 1 = 1")
    out = rows.withColumn("_at", F.when(key.isNotNull(), at)).crossJoin(F.broadcast(bits))
    return out.withColumn("_marked", F.coalesce(bit, F.lit(False))).drop("_bits", "_at")
