"""Reachability over references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reachable(edges: DataFrame, starts: DataFrame, cut: Callable[[DataFrame], DataFrame], most: int = 64) -> DataFrame:
    """start, node: all that each start (column start) reaches over edges a -> b.

    A round joins the newest nodes with the edges and keeps those not seen before, so loops end; ``cut`` cuts the lineage each
    round, such as by a checkpoint in a shared folder.
    """
    onward = edges.select(F.col("a").alias("node"), F.col("b").alias("next"))
    found = new = cut(starts.select("start", F.col("start").alias("node")).join(onward, "node").select("start", F.col("next").alias("node")).distinct())
    for _ in range(most):
        step = new.join(onward, "node").select("start", F.col("next").alias("node")).distinct()
        new = cut(step.join(found, ["start", "node"], "left_anti"))
        if new.isEmpty():
            return found
        found = found.unionAll(new)
    raise RuntimeError(f"more than {most} steps")
