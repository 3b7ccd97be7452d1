"""Publication: written aside, read back and checked, then put in place, or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folio.plans.registry import shared


class Refused(RuntimeError):
    """What was written didn't pass its check; nothing has been put in place."""


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return bool(fs.exists(p))


def digest(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free sum of hashes."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns) % 1_000_000_007).alias("h")).first()
    return row["n"], row["h"] or 0


def published(df: DataFrame, target: str, check: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """Writes ``df`` beside ``target``, reads it back, tests rows, hashes and ``check``, and renames it. Refuses a target that exists.

    Rows and hashes are counted while ``df`` is written, so it runs once and needn't give the same rows twice.
    """
    spark = df.sparkSession
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    fs, goal = _path(spark, target)
    _, aside = _path(spark, staging)
    if fs.exists(goal):
        raise Refused(f"{target} exists")
    try:
        seen = Observation(f"written-{uuid.uuid4().hex}")
        rows, hashes = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns) % 1_000_000_007).alias("h")
        df.observe(seen, rows, hashes).write.parquet(staging)
        back = spark.read.schema(df.schema).parquet(staging)
        if digest(back) != (seen.get["n"], seen.get["h"] or 0):
            raise Refused("what was read back differs from what was written")
        if check and not check(back):
            raise Refused("the check failed")
        if not fs.rename(aside, goal):
            raise Refused(f"{target} could not be put in place")
    finally:
        fs.delete(aside, True)
    return spark.read.schema(df.schema).parquet(target)


def rewritten(parts: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Parts with the changed ones in place of their old selves, and whether each is one. New parts are added."""
    kept = parts.join(changed.select(*keys), keys, "left_anti").withColumn("changed", F.lit(False))
    return kept.unionByName(changed.withColumn("changed", F.lit(True)))
