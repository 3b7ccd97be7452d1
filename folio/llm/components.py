"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import checkpoint, release

#: Rounds after which the work counts as broken; the rounds needed grow with the logarithm of the nodes.
MOST_ROUNDS = 60


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has u > v. The minima are checkpointed so that the join deals both sides itself and a node with very many
    edges can be split among tasks."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(checkpoint(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(checkpoint(least), "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return checkpoint(out.where("u > v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """id, component of every node of ``edges`` (columns a, b: 64-bit ids, any order, repeats allowed); component is the smallest id.

    Rows with a null end are ignored; an empty table gives an empty one; self-links add their node. Nothing but two numbers a
    round goes to the driver. Each round cuts the lineage by a checkpoint in the shared folder.
    """
    clean = checkpoint(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    alone = clean.where("u = v").select(F.col("u").alias("id"))
    now = clean.where("u > v")
    seen = _print_of(now)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        now = _star(_star(now, large=True), large=False)
        if (got := _print_of(now)) == seen:
            break
        seen = got
        release(edges.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    labelled = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    rest = alone.select("id", F.col("id").alias("component"))
    return labelled.unionAll(roots).unionAll(rest).groupBy("id").agg(F.min("component").alias("component"))
