"""Latest annotations, scene windows and visits over streams, and how a stream is run to its end.

State is kept per key and bounded: one record per episode, the windows and visits
within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that its source has now, written under path and read back.

    The state is kept in RocksDB beside it; a later call with the same path goes on
    from the checkpoint.
    """
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
    finally:
        spark.conf.set(name, old)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def latest_annotation_stream(log: DataFrame) -> DataFrame:
    """T-8: the last record of each episode, for update or complete mode; log has seq."""
    return log.groupBy("episode_id").agg(F.max_by(F.struct("human_label", "qc_state", "seq"), "seq").alias("r")).select("episode_id", "r.human_label", "r.qc_state", "r.seq")


def scene_window_stream(samples: DataFrame, window: str = "2 seconds", stride: str = "1 second", late: str = "2 seconds") -> DataFrame:
    """T-9: distinct episodes and samples of each sliding window of event time ts; windows end exclusively and close behind the watermark.

    A window's state holds its episode ids, of which a scene has a few hundred.
    """
    return samples.withWatermark("ts", late).groupBy(F.window("ts", window, stride).alias("w"), "scene").agg(F.size(F.collect_set("episode_id")).alias("episodes"), F.count("*").alias("samples")).select("scene", "w.start", "w.end", "episodes", "samples")


def session_stream(samples: DataFrame, gap: str = "8 hours", late: str = "2 hours", key: str = "episode_id") -> DataFrame:
    """T-3: visits of each key: runs of samples (key, ts) that no gap interrupts, closed once the watermark is a gap behind their last sample."""
    visits = samples.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("samples"), F.max("ts").alias("last"))
    return visits.select(key, F.col("w.start").alias("start"), "last", "samples")
