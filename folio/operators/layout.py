"""Layout from geometry: rows, cells, bands, margins, votes and line breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchors(df: DataFrame, by: list[str], y: str, tol: float) -> DataFrame:
    """by, anchor: where rows start. A value opens a row when it lies more than ``tol`` beyond the row's first value.

    The comparison is with the row's first member and not with the one before, so a window can't say it: a fold over the
    group's sorted values does. A group is one page, which bounds the fold.
    """
    found = F.aggregate(
        F.array_sort(F.collect_list(F.col(y).cast("double"))),
        F.array().cast("array<double>"),
        lambda out, v: F.when(F.size(out) == 0, F.array(v)).when(v - F.element_at(out, -1) > tol, F.concat(out, F.array(v))).otherwise(out),
    )
    return df.groupBy(*by).agg(found.alias("_a")).select(*by, F.explode("_a").alias("anchor"))


def in_rows(df: DataFrame, by: list[str], y: str, tol: float) -> DataFrame:
    """``df`` with ``anchor``, the first value of the row that each record lies in."""
    rows = anchors(df, by, y, tol).groupBy(*by).agg(F.sort_array(F.collect_list("anchor")).alias("_all"))
    joined = df.join(rows, by)
    return joined.withColumn("anchor", F.array_max(F.filter("_all", lambda a: a <= F.col(y)))).drop("_all")


def islands(df: DataFrame, by: list[str], start: str, end: str, slack: float, ties: list[str] | None = None) -> DataFrame:
    """``df`` with ``island``: intervals that follow within ``slack`` of the furthest end so far are one.

    Nulls come last, as in the SQL of the queries: an interval without an end opens nothing before those that have one. Both windows
    have one order and read one sort, so intervals equal in it keep their places from one to the other.
    """
    order = [F.col(c).asc_nulls_last() for c in [start, end, *(ties or [])]]
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    furthest = df.withColumn("_m", F.max(end).over(before))
    opens = F.when(F.col("_m").isNull() | (F.col(start) - F.col("_m") > slack), 1).otherwise(0)
    return furthest.withColumn("_o", opens).withColumn("island", F.sum("_o").over(upto)).drop("_m", "_o")


def coalesced(df: DataFrame, by: list[str], start: str, end: str, slack: float, every: Column | None = None) -> DataFrame:
    """by, island, lo, hi, n and, if ``every`` is given, whether it holds for all members."""
    flag = [] if every is None else [F.bool_and(every).alias("every")]
    return islands(df, by, start, end, slack).groupBy(*by, "island").agg(F.min(start).alias("lo"), F.max(end).alias("hi"), F.count("*").alias("n"), *flag)


def by_rank(df: DataFrame, by: list[str], value: str, share: int = 20) -> DataFrame:
    """by, n, low, high: the values ``n div share`` places from either end, 0 being the first.

    Ranks come from counts of distinct values, so a hot value is one row of the running sum.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    window = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("c").over(window)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    step = F.floor(F.col("n") / share)
    low = F.min(F.when(F.col("upto") > step, F.col(value)))
    high = F.min(F.when(F.col("upto") >= F.col("n") - step, F.col(value)))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), low.alias("low"), high.alias("high"))


def vote(df: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """by, value, votes: the most frequent value, the first seen of equals."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("votes"), F.min(seq).alias("_first"))
    return counts.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("votes"), "_first"))).where("_k = 1").select(*by, value, "votes")


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median: of an even number of values the larger of the middle two."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    window = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("c").over(window)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    return ranked.groupBy(*by).agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(value))).alias("median"))


def wrapped(text: Column, width: int) -> Column:
    """Number of lines of a greedy wrap; null if a word is wider than a line."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    fold = F.aggregate(
        words,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("lines")),
        lambda acc, w: F.when((acc["at"] > 0) & (acc["at"] + 1 + F.length(w) <= width), F.struct((acc["at"] + 1 + F.length(w)).alias("at"), acc["lines"].alias("lines"))).otherwise(F.struct(F.length(w).alias("at"), (acc["lines"] + 1).alias("lines"))),
        lambda acc: acc["lines"],
    )
    return F.when(F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)) <= width, fold)


def joined_cell(spans: Column, glue: float = 0.15) -> Column:
    """Text of sorted spans (x0, x1, size, text): a space where the gap is wide and none is there yet."""
    return F.aggregate(
        spans,
        F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("x1")),
        lambda acc, s: F.struct(
            F.concat(acc["text"], F.when(acc["x1"].isNotNull() & (s["x0"] - acc["x1"] > glue * s["size"]) & ~acc["text"].endswith(" "), " ").otherwise(""), s["text"]).alias("text"),
            s["x1"].cast("double").alias("x1"),
        ),
        lambda acc: acc["text"],
    )


def depth(markers: Column) -> Column:
    """Nesting depth after a sequence of +1 and -1, never under 0."""
    return F.aggregate(markers, F.lit(0), lambda d, m: F.greatest(d + m, F.lit(0)))
