"""Queries on grids, spans, merges, column types and widths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as ft
from folio.operators import grids
from folio.plans.blocks import HTML_PARTS
from folio.plans.layouts import LINE_KEY
from folio.plans.registry import query, table
from folio.sources import blocks as src

PIPES = "select doc_id, cast(g - 1 as integer) as row_ix, string_split(a[g], '|') as c from (select doc_id, string_split(text, chr(10)) as a from documents) d, unnest(range(1, len(a) + 1)) u(g) where contains(a[g], '|')"
CELLS = f"select doc_id, row_ix, cast(h - 1 as integer) as col_ix, trim(c[h]) as text from ({PIPES}) p, unnest(range(1, len(c) + 1)) v(h)"
#: The same pattern as the other engine spells it.
NUMBER = ft.NUMBER.replace("\\u00a0", "\\x{00a0}")


@query(
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(l_quantity as bigint) as span,
cast(coalesce(sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and 1 preceding), 0) as bigint) as start from lineitem"""
)
def grid_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_KEY, F.col("l_quantity").cast("bigint").alias("span"))
    return grids.grid_starts(cells, ["l_orderkey"], LINE_KEY, "span")


@query("select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as source from conversations")
def vertical_merge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return grids.merge_sources(cells, ["conv_id"], "turn", F.col("role") == "user").drop("role")


@query(
    """with w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, greatest(cast(round_even(l_quantity * 9000 / sum(l_quantity) over (partition by l_orderkey), 0) as bigint), 1) as w,
 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k, count(*) over (partition by l_orderkey) as n from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(case when k = n then 9000 - (sum(w) over (partition by l_orderkey) - w) else w end as bigint) as fitted from w"""
)
def width_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column widths rescaled to 9,000, the rest to the last column."""
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_KEY, "l_quantity")
    return grids.refitted(w, ["l_orderkey"], LINE_KEY, "l_quantity", 9000).drop("l_quantity")


@query(
    """with c as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as col_ix, cast(floor(o_totalprice) as bigint) as width from orders),
s as (select distinct o_custkey, cast(o_custkey % 3 as bigint) as row_ix, cast(0 as bigint) as cell_ix, cast(o_custkey % 4 as bigint) as start, cast(2 as bigint) as span from orders)
select s.o_custkey, s.row_ix, s.cell_ix, cast(case when max(case when col_ix = start + span - 1 then 1 end) = 1 then sum(width) filter (where col_ix >= start and col_ix < start + span) end as bigint) as width from s join c using (o_custkey) group by 1, 2, 3"""
)
def cell_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of cells that span two columns: the columns' widths summed, null where the grid is too short."""
    o = table(spark, sf_dir, "orders")
    columns = grids.renumbered(o, ["o_custkey"], ["o_orderkey"], "col_ix").select("o_custkey", "col_ix", F.floor("o_totalprice").alias("width"))
    cells = o.select("o_custkey").distinct().select("o_custkey", (F.col("o_custkey") % 3).alias("row_ix"), F.lit(0).cast("bigint").alias("cell_ix"), (F.col("o_custkey") % 4).alias("start"), F.lit(2).cast("bigint").alias("span"))
    return grids.cell_widths(cells, columns, ["o_custkey"])


@query(
    f"""with c as ({CELLS}) select doc_id, col_ix, count(*) as n_cells, count(*) filter (where text <> '') as n_filled,
bool_and(text = '' or regexp_matches(text, '{NUMBER}')) and bool_or(text <> '' and regexp_matches(text, '{NUMBER}')) as numeric from c where row_ix > 0 group by doc_id, col_ix"""
)
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.numeric_columns(src.cells(src.pipe_rows(table(spark, sf_dir, "documents"))), ["doc_id", "col_ix"])


@query(
    f"""with v as (select o_orderkey, cast(o_custkey as varchar) as n, o_orderkey % 10 as k, o_orderpriority as p from orders),
t as (select o_orderkey, case k when 0 then n || ',0' when 1 then '+' || n || ',2 %' when 2 then '−3,' || n || ' %' when 3 then n || ' 200 млн' when 4 then p when 5 then n || 'e5' when 6 then '' when 7 then n || chr(160) || '000 €' when 8 then n || ' ' || p else '+3,8 п.п.' end as text from v)
select o_orderkey, text, text <> '' and regexp_matches(text, '{NUMBER}') as numeric from t"""
)
def number_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells count as numbers: signs, groups, decimal commas and units."""
    n, k, p = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 10, F.col("o_orderpriority")
    forms = [(n, ",0"), ("+", n, ",2 %"), ("−3,", n, " %"), (n, " 200 млн"), (p,), (n, "e5"), ("",), (n, "\u00a0000 €"), (n, " ", p), ("+3,8 п.п.",)]
    text = F.element_at(F.array(*[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in form]) for form in forms]), (k + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).withColumn("numeric", (F.col("text") != "") & ft.is_number(F.col("text")))


@query(f"with c as ({CELLS}) select doc_id, col_ix, cast(least(greatest(max(length(text)), 4), 40) as bigint) as weight from c group by doc_id, col_ix")
def column_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.column_weights(src.cells(src.pipe_rows(table(spark, sf_dir, "documents"))), ["doc_id", "col_ix"])


@query(
    """with n as (select l_orderkey, count(*) as n from lineitem group by l_orderkey)
select l_orderkey, n, cast((9360 - (n - 1) * 36) // n as bigint) as width, cast(9360 - (n - 1) * 36 - ((9360 - (n - 1) * 36) // n) * (n - 1) as bigint) as last_width from n"""
)
def section_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal columns of a section with gaps, the rest to the last."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    usable = F.lit(9360) - (F.col("n") - 1) * 36
    width = F.floor(usable / F.col("n"))
    return n.select("l_orderkey", "n", width.cast("bigint").alias("width"), (usable - width * (F.col("n") - 1)).cast("bigint").alias("last_width"))


@query(
    """with t as (select page_id, cast(row_number() over (order by page_id) - 1 as bigint) as p from pages)
select page_id, p // 24 as sheet, (p % 24) // 4 as row_ix, p % 4 as col_ix from t"""
)
def contact_sheet_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of pages on sheets of 24 in 4 columns. Pages are numbered by counts of ranges, so no task sorts them all."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    ranged = pages.withColumn("part", F.floor(F.col("page_id") / 4096))
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))
    # Sums of ranges of ranges first, so that the window over all has a row for each 4096 * 4096 ids.
    coarse = before.withColumn("whole", F.floor(F.col("part") / 4096))
    totals = coarse.groupBy("whole").agg(F.sum("n").alias("t"))
    earlier = totals.select("whole", F.coalesce(F.sum("t").over(Window.orderBy("whole").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("whole").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = coarse.withColumn("inside", inside).join(earlier, "whole").select("part", (F.col("earlier") + F.col("inside")).alias("before"))
    placed = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("page_id"))).join(offsets, "part")
    p = F.col("before") + F.col("k") - 1
    return placed.select("page_id", F.floor(p / 24).alias("sheet"), F.floor((p % 24) / 4).alias("row_ix"), (p % 4).alias("col_ix"))


@query(
    HTML_PARTS
    + r"""b as (select page_id, cast(g - 1 as integer) as block_ix, lower(regexp_extract(a[g], '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from parts, unnest(range(1, len(a) + 1)) u(g)),
n as (select page_id, block_ix, tag, sum(case when tag = 'h1' then 1 else 0 end) over (partition by page_id order by block_ix rows unbounded preceding) as h, tag = 'p' as is_p from b),
c as (select page_id, block_ix, tag, h, sum(case when is_p then 1 else 0 end) over (partition by page_id, h order by block_ix rows unbounded preceding) as k from n)
select page_id, block_ix, h || '.' || k as number from c where tag in ('h1', 'p')"""
)
def heading_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers like 1.2: a counter for each level that starts anew below each parent."""
    b = src.html_blocks(table(spark, sf_dir, "pages"))
    upto = Window.partitionBy("page_id").orderBy("block_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = b.withColumn("h", F.sum(F.when(F.col("tag") == "h1", 1).otherwise(0)).over(upto))
    inner = Window.partitionBy("page_id", "h").orderBy("block_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = h.withColumn("k", F.sum(F.when(F.col("tag") == "p", 1).otherwise(0)).over(inner))
    return k.where("tag in ('h1', 'p')").select("page_id", "block_ix", F.concat_ws(".", F.col("h").cast("string"), F.col("k").cast("string")).alias("number"))
