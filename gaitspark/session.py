"""What a session needs for this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])
_WRITTEN: list[tuple[SparkSession, str]] = []


def share_package(spark: SparkSession) -> None:
    """Let Python workers import the package wherever the driver found it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that nobody uses yet in the folder that driver and executors share; what is written there goes when the driver ends.

    The folder is spark.checkpoint.dir; a local session without it takes a temporary
    one, a cluster without it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/gaitspark-settled-{os.getuid()}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *cols: str) -> DataFrame:
    """df with no, its rows' numbers from 0 in the order of cols, written; no task sees more than its range of the order."""
    at = F.monotonically_increasing_id()
    parts = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumns({"_part": F.shiftright(at, 33), "_nth": at.bitwiseAND(F.lit((1 << 33) - 1))})
    written = settled(parts, "ranked")
    # One row for each part.
    counts = written.groupBy("_part").agg(F.count("*").alias("_c"))
    starts = counts.select("_part", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return written.join(F.broadcast(starts), "_part").withColumn("no", F.col("_start") + F.col("_nth")).drop("_part", "_nth", "_start")


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone by now
            return


atexit.register(_clean)
