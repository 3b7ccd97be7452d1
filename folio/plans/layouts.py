"""Queries on clustering, islands, votes, percentiles and line breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators import layout, lookup
from folio.plans.registry import query, table

#: l_orderkey and l_linenumber are no key; these are.
LINE_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    """with recursive a as (select l_orderkey, min(l_quantity) as anchor from lineitem group by l_orderkey
  union all select a.l_orderkey, (select min(l.l_quantity) from lineitem l where l.l_orderkey = a.l_orderkey and l.l_quantity > a.anchor + 5) from a where (select min(l.l_quantity) from lineitem l where l.l_orderkey = a.l_orderkey and l.l_quantity > a.anchor + 5) is not null)
select l_orderkey, anchor from a"""
)
def anchor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of values within 5 of their first."""
    return layout.anchors(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", 5.0)


@query(
    """with x as (select l_orderkey, l_quantity as y0, l_quantity + l_tax * 50 as y1, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem),
m as (select *, max(y1) over (partition by l_orderkey order by y0, y1 rows between unbounded preceding and 1 preceding) as pm from x),
i as (select *, sum(case when pm is null or y0 - pm > 1.6 then 1 else 0 end) over (partition by l_orderkey order by y0, y1 rows unbounded preceding) as island from m)
select l_orderkey, cast(island as bigint) as island, min(y0) as lo, max(y1) as hi, count(*) as n, bool_and(y1 - y0 <= 2) as every from i group by l_orderkey, island"""
)
def interval_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that follow within 1.6 of each other as one, and whether all members are thin."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("y0"), (F.col("l_quantity") + F.col("l_tax") * 50).alias("y1"))
    return layout.coalesced(x, ["l_orderkey"], "y0", "y1", 1.6, F.col("y1") - F.col("y0") <= 2).withColumn("island", F.col("island").cast("bigint"))


@query(
    """with r as (select l_returnflag, l_extendedprice as x, row_number() over (partition by l_returnflag order by l_extendedprice) as rn, count(*) over (partition by l_returnflag) as n from lineitem)
select l_returnflag, max(n) as n, max(case when rn = n // 20 + 1 then x end) as low, max(case when rn = n - n // 20 then x end) as high from r group by l_returnflag"""
)
def index_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins: the values a twentieth of the way in from either end, by index."""
    return layout.by_rank(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query(
    """with c as (select user_id, event_type, count(*) as votes, min(event_id) as f from events group by 1, 2),
r as (select *, row_number() over (partition by user_id order by votes desc, f) as k from c) select user_id, event_type, votes from r where k = 1"""
)
def alignment_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.vote(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query(
    """with r as (select l_orderkey, l_quantity, row_number() over (partition by l_orderkey order by l_quantity) as rn, count(*) over (partition by l_orderkey) as n from lineitem)
select l_orderkey, max(case when rn = n // 2 + 1 then l_quantity end) as median from r group by l_orderkey"""
)
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.upper_median(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity")


@query(
    """with c as (select l_returnflag, round_even(l_discount * 100, 0) as size, count(*) as n from lineitem group by 1, 2),
r as (select *, row_number() over (partition by l_returnflag order by n desc, size) as k from c) select l_returnflag, size, n from r where k = 1"""
)
def modal_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent rounded size, the smallest of equals."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.bround(F.col("l_discount") * 100, 0).alias("size")).agg(F.count("*").alias("n"))
    return lookup.best(sizes, ["l_returnflag"], [F.desc("n"), F.col("size")])


@query("select a.event_id, count(*) as n, max(b.value) as hi, min(b.value) as lo from events a join events b on b.event_id between a.event_id - 300 and a.event_id + 300 and b.user_id = a.user_id and abs(b.value - a.value) <= 1.2 and b.event_id <> a.event_id group by a.event_id")
def neighbour_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the bounds of its user's events nearby in order and value."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_id") - 300).alias("e0"), (F.col("event_id") + 300).alias("e1"))
    other = e.select("user_id", F.col("event_id").alias("b_id"), F.col("value").alias("b_value"), F.col("event_id").alias("b0"), F.col("event_id").alias("b1"))
    pairs = lookup.overlapping(e, other, ["user_id"], "e0", "e1", "b0", "b1", 600)
    near = pairs.where((F.abs(F.col("b_value") - F.col("value")) <= 1.2) & (F.col("b_id") != F.col("event_id")))
    return near.groupBy("event_id").agg(F.count("*").alias("n"), F.max("b_value").alias("hi"), F.min("b_value").alias("lo"))


@query(
    """with recursive w as (select item_id, string_split_regex(text, '\\s+') as a from benchmark), v as (select item_id, list_filter(a, lambda x: x <> '') as a from w),
f as (select item_id, a, 0 as i, 0 as cur, 0 as lines from v union all
  select item_id, a, i + 1, case when cur > 0 and cur + 1 + length(a[i + 1]) <= 40 then cur + 1 + length(a[i + 1]) else length(a[i + 1]) end, case when cur > 0 and cur + 1 + length(a[i + 1]) <= 40 then lines else lines + 1 end from f where i < len(a))
select item_id, cast(max(lines) as integer) as lines from f where i = len(a) group by item_id""".replace("\\\\", "\\")
)
def line_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a greedy wrap to 40 characters takes."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", layout.wrapped(F.col("text"), 40).alias("lines"))


@query(
    """with s as (select l_orderkey, l_linenumber, l_quantity as x0, l_quantity + l_tax * 20 as x1, l_partkey, l_suppkey, l_extendedprice from lineitem),
g as (select *, case when lag(x1) over w is null or x0 - lag(x1) over w > 5 then 1 else 0 end as opens from s window w as (partition by l_orderkey order by x0, x1, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
c as (select *, sum(opens) over (partition by l_orderkey order by x0, x1, l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) as cell from g)
select l_orderkey, cast(cell as bigint) as cell, min(x0) as x0, max(x1) as x1, count(*) as n from c group by l_orderkey, cell"""
)
def cell_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a row: a gap of more than 5 to the span before opens one."""
    s = table(spark, sf_dir, "lineitem").withColumns({"x0": F.col("l_quantity"), "x1": F.col("l_quantity") + F.col("l_tax") * 20})
    w = Window.partitionBy("l_orderkey").orderBy("x0", "x1", *LINE_KEY)
    opens = s.withColumn("opens", F.when(F.lag("x1").over(w).isNull() | (F.col("x0") - F.lag("x1").over(w) > 5), 1).otherwise(0))
    cells = opens.withColumn("cell", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("bigint"))
    return cells.groupBy("l_orderkey", "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"))


@query("select conv_id, string_agg(case when p is null then text when g > 0.15 and p not like '% ' then ' ' || text else text end, '' order by turn) as text from (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as p, (turn % 3) * 0.1 as g from conversations) group by conv_id")
def cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of a cell from its spans: a space where the gap is wide and none is there yet."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    span = F.struct("turn", F.col("turn").cast("double").alias("x0"), (F.col("turn") + 1.0 - ((F.col("turn") + 1) % 3) * 0.1).alias("x1"), F.lit(1.0).alias("size"), "text")
    return c.groupBy("conv_id").agg(layout.joined_cell(F.sort_array(F.collect_list(span))).alias("text"))


@query(
    """with recursive m as (select conv_id, turn, case when role = 'user' then 1 else -1 end as d, row_number() over (partition by conv_id order by turn) as i from conversations),
f as (select conv_id, cast(0 as bigint) as i, 0 as depth from (select distinct conv_id from m) union all select f.conv_id, m.i, greatest(f.depth + m.d, 0) from f join m on m.conv_id = f.conv_id and m.i = f.i + 1)
select conv_id, cast(arg_max(depth, i) as integer) as depth from f group by conv_id"""
)
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth after begin and end markers, never under 0."""
    m = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.when(F.col("role") == "user", 1).otherwise(-1).alias("d")).alias("m"))
    ordered = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    return ordered.select("conv_id", layout.depth(F.transform("ms", lambda x: x["d"])).alias("depth"))


@query("select conv_id, turn, cast(coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as start, cast(length(text) as bigint) as n_chars from conversations")
def run_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run starts in its paragraph's text."""
    c = table(spark, sf_dir, "conversations").withColumn("n_chars", F.length("text").cast("bigint"))
    return lookup.running(c, ["conv_id"], ["turn"], F.col("n_chars"), "start").select("conv_id", "turn", F.col("start").cast("bigint").alias("start"), "n_chars")


@query(
    """with p as (select user_id, event_id, value, lag(value) over (partition by user_id order by ts, event_id) as pv from events),
g as (select user_id, abs(value - pv) as gap, row_number() over (partition by user_id order by abs(value - pv)) as rn, count(*) over (partition by user_id) as n from p where pv is not null)
select user_id, max(case when rn = n // 2 + 1 then gap end) as pitch from g group by user_id"""
)
def line_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of the gaps between neighbours."""
    e = table(spark, sf_dir, "events")
    gaps = e.withColumn("gap", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))).where("gap is not null")
    return layout.upper_median(gaps, ["user_id"], "gap").withColumnRenamed("median", "pitch")


@query(
    """with r as (select event_id, user_id, value, max(value) filter (where event_type = 'purchase') over w as above, lead(value) over (partition by user_id order by ts, event_id) as nxt from events
 window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
select event_id, above, nxt, case when above is not null and above < value then above when nxt is not null then (value + nxt) / 2 else value end as top from r"""
)
def row_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's upper edge: the nearest separator above, else half-way to the next row, else its own."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    above = F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = e.select("event_id", "value", above.alias("above"), F.lead("value").over(w).alias("nxt"))
    return r.select("event_id", "above", "nxt", F.when(F.col("above") < F.col("value"), F.col("above")).when(F.col("nxt").isNotNull(), (F.col("value") + F.col("nxt")) / 2).otherwise(F.col("value")).alias("top"))


@query("with o as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) - 1 as ix from orders) select a.o_orderkey, max(b.o_totalprice) filter (where b.o_totalprice < a.o_totalprice) as below, min(b.o_totalprice) filter (where b.o_totalprice > a.o_totalprice) as above from o a join o b on b.o_custkey = a.o_custkey and b.ix between a.ix - 6 and a.ix + 6 group by a.o_orderkey")
def column_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest values below and above within six rows: a window frame and no self-join."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    near = o.withColumn("near", F.collect_list("o_totalprice").over(w.rowsBetween(-6, 6)))
    pick = lambda f, test: f(F.filter("near", test))
    return near.select("o_orderkey", pick(F.array_max, lambda v: v < F.col("o_totalprice")).alias("below"), pick(F.array_min, lambda v: v > F.col("o_totalprice")).alias("above"))


@query(
    """with s as (select l_orderkey, l_linenumber, l_quantity as y, l_extendedprice from lineitem),
b as (select l_orderkey, y, count(*) as n from s group by 1, 2)
select l_orderkey, count(*) as n_rows, max(n) as most from b group by l_orderkey"""
)
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual rows of each page and the most cells that one has."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_quantity").agg(F.count("*").alias("n"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), F.max("n").alias("most"))
