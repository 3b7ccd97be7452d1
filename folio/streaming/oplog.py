"""Counts of ops by kind and time window from a growing log, and batches of a log applied as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def log(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(stream: DataFrame, ts: str = "ts", op: str = "event_type", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """op, start, n: ops of each kind in each window; rows later than ``late`` are dropped, so the state stays bounded."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", size).alias("w"), F.col(op).alias("op")).agg(F.count("*").alias("n")).select("op", F.col("w.start").alias("start"), "n")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to ``apply`` with its number; a restart repeats a batch under the same number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
