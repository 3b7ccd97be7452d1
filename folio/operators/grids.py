"""Tables: grids with spans and merges, column types and widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as ft

#: Bounds of a column's weight in characters.
LEAST_WEIGHT, MOST_WEIGHT = 4, 40


def grid_starts(cells: DataFrame, by: list[str], order: list[str], span: str) -> DataFrame:
    """``cells`` with ``start``: the grid column that each begins in, the spans before it."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("start", F.coalesce(F.sum(span).over(window), F.lit(0)).cast("bigint"))


def merge_sources(cells: DataFrame, by: list[str], row: str, restart: Column, gap: Column | None = None) -> DataFrame:
    """``cells`` with ``source``: the row where the vertical merge that a cell continues began; null where ``gap`` broke it."""
    window = Window.partitionBy(*by).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    began = F.last(F.when(restart, F.col(row)), ignorenulls=True).over(window)
    if gap is None:
        return cells.withColumn("source", began)
    broken = F.last(F.when(gap, F.col(row)), ignorenulls=True).over(window)
    return cells.withColumn("source", F.when(broken.isNull() | (broken < began), began))


def refitted(widths: DataFrame, by: list[str], order: list[str], width: str, total: int) -> DataFrame:
    """``widths`` with ``fitted``: rescaled to ``total``, half to even, one at least, the rest to the last column."""
    whole = Window.partitionBy(*by)
    place = Window.partitionBy(*by).orderBy(*order)
    share = F.greatest(F.bround(F.col(width) * total / F.sum(width).over(whole), 0).cast("bigint"), F.lit(1).cast("bigint"))
    scaled = widths.withColumn("_w", share).withColumn("_k", F.row_number().over(place)).withColumn("_n", F.count("*").over(whole))
    rest = F.lit(total) - (F.sum("_w").over(whole) - F.col("_w"))
    return scaled.withColumn("fitted", F.when(F.col("_k") == F.col("_n"), rest).otherwise(F.col("_w")).cast("bigint")).drop("_w", "_k", "_n")


def cell_widths(cells: DataFrame, columns: DataFrame, by: list[str]) -> DataFrame:
    """by, row_ix, cell_ix, width: the widths of the grid columns that each cell (start, span) covers, by prefix sums."""
    window = Window.partitionBy(*by).orderBy("col_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = columns.withColumn("upto", F.sum("width").over(window)).select(*by, "col_ix", "upto")
    ends = cells.withColumn("_last", F.col("start") + F.col("span") - 1).join(sums.withColumnRenamed("col_ix", "_last"), [*by, "_last"], "left")
    heads = sums.select(*by, (F.col("col_ix") + 1).alias("start"), F.col("upto").alias("_before"))
    return ends.join(heads, [*by, "start"], "left").select(*by, "row_ix", "cell_ix", (F.col("upto") - F.coalesce("_before", F.lit(0))).alias("width"))


def numeric_columns(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, n_cells, n_filled, numeric: whether every filled cell below the header is a number, and at least one is."""
    filled = F.trim("text") != ""
    number = ft.is_number(F.col("text"))
    body = cells.where("row_ix > 0")
    return body.groupBy(*by).agg(F.count("*").alias("n_cells"), F.count_if(filled).alias("n_filled"), (F.bool_and(number | ~filled) & F.bool_or(number & filled)).alias("numeric"))


def column_weights(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, weight: the longest text of a column within the bounds."""
    longest = F.max(F.length("text"))
    return cells.groupBy(*by).agg(F.least(F.greatest(longest, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)).cast("bigint").alias("weight"))


def renumbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name`` counting from 0 in the given order."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))
