"""Lookups by order and by range: as-of, islands, binned theta joins and inheritance along chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_value(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the first ``value`` that isn't null at or after each row."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn(name, F.first(value, ignorenulls=True).over(window))


def last_value(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the last ``value`` that isn't null at or before each row."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(window))


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before, 0 at the first."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))


def section_ends(headings: DataFrame, key: str, index: str, level: str, sizes: DataFrame) -> DataFrame:
    """key, index, level, end: where each heading's section ends: the next heading of its level or above, else the document's size.

    Outline levels go from 0 to 8, deeper ones count as 8; so the next heading of each level is carried along one window and the least taken: no
    heading is compared with all others.
    """
    window = Window.partitionBy(key).orderBy(index).rowsBetween(1, Window.unboundedFollowing)
    own = F.least(F.col(level), F.lit(8))
    ends = [F.when(own >= k, F.min(F.when(own == k, F.col(index))).over(window)) for k in range(9)]
    found = headings.withColumn("_end", F.least(*ends))
    return found.join(sizes, key).select(key, index, level, F.coalesce("_end", "size").alias("end"))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], l0: str, l1: str, r0: str, r1: str, width: float) -> DataFrame:
    """Pairs of rows whose closed intervals meet, by an equi-join on bins of ``width``.

    A pair that meets in several bins comes once: in the bin where the later of the two starts lies.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    x = left.withColumn("_bin", bins(l0, l1))
    y = right.withColumn("_bin", bins(r0, r1))
    joined = x.join(y, [*by, "_bin"]).where((F.col(l0) <= F.col(r1)) & (F.col(r0) <= F.col(l1)))
    return joined.where(F.col("_bin") == F.floor(F.greatest(F.col(l0), F.col(r0)) / width)).drop("_bin")


def inherited(nodes: DataFrame, key: str, parent: str, value: str, most: int = 10) -> DataFrame:
    """key, value: each node's own value, else the nearest ancestor's, ``most`` steps up at most; cycles end with the steps.

    Stretches of the chain double, so this takes a few joins and not one for each step.
    """
    def after(a: DataFrame, b: DataFrame) -> DataFrame:
        """A stretch of the chain and the one that follows it as one: the nearest value in either, and the node behind both."""
        up = b.select(F.col(key).alias("_p"), F.col("_p").alias("_pp"), F.col("_v").alias("_pv"))
        return a.join(up, "_p", "left").select(key, F.col("_pp").alias("_p"), F.coalesce("_v", "_pv").alias("_v"))

    # A node and ``most`` steps are most + 1 nodes; stretches of 1, 2, 4, ... of them make up that many exactly.
    stretch = nodes.select(F.col(key), F.col(parent).alias("_p"), F.col(value).alias("_v"))
    now, left = None, most + 1
    while left:
        if left & 1:
            now = stretch if now is None else after(now, stretch)
        left >>= 1
        if left:
            stretch = after(stretch, stretch)
    return now.select(key, F.col("_v").alias(value))


def best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def smallest_unused(ids: DataFrame, key: str) -> DataFrame:
    """free: the smallest positive whole number that ``key`` lacks, in one pass over the sorted distinct ids."""
    used = ids.where(F.col(key) > 0).select(F.col(key).alias("k")).distinct()
    # k + 1 is free if nothing has it; 1 is free if nothing has it.
    after = used.select((F.col("k") + 1).alias("free")).unionAll(ids.sparkSession.range(1).select(F.lit(1).cast("bigint").alias("free")))
    return after.join(used.select(F.col("k").alias("free")), "free", "left_anti").agg(F.min("free").alias("free"))
