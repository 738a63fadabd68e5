"""Streaming quotas, incremental ingest and tumbling counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators.usage import HARD_LIMIT, SOFT_LIMIT
from corvina.streaming import stateful


def verdicts(requests: DataFrame, hard: int = HARD_LIMIT, soft: int = SOFT_LIMIT) -> DataFrame:
    """A stream of requests (user_id, ts, event_id) with the verdict of each; the count of a key and local day is its state.

    It is stateful.counted() without plans, so its state must live in RocksDB, where run_once() puts it.
    """
    out = stateful.counted(requests, hard=hard, soft=soft)
    user = F.substring("who", 2, 20).cast("long").alias("user_id")
    return out.select(user, "period", "event_id", "used", "allowed", "suggest")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; what comes later than the watermark is dropped by the engine."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def run_once(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Drain what is there into Parquet and give the result as a table; the state lives in RocksDB."""
    out = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    with stateful.rocks(spark):
        out.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def ingest(stream: DataFrame, target: str, key: str, checkpoint: str) -> None:
    """Append each micro-batch's unseen keys to a Parquet table; a replayed batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(target).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = batch.select(key).limit(0)
        batch.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(target)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
