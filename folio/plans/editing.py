"""Queries on edits: replacements, inserts, deletes, moves, rows, columns, cells, pages and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import geometry as geo
from folio.functions import text as ft
from folio.operators import edits, grids
from folio.plans.registry import query, table
from folio.sources import blocks as src

LINES = "select d.doc_id, cast(g - 1 as integer) as block_ix, a[g] as text from (select doc_id, string_split(text, chr(10)) as a from documents) d, unnest(range(1, len(a) + 1)) u(g)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents; every third one, from the first on, is a heading whose level follows from its place."""
    b = src.text_blocks(table(spark, sf_dir, "documents"))
    level = F.when(F.col("block_ix") % 3 == 0, (F.floor(F.col("block_ix") / 3) % 3).cast("int"))
    return b.select("doc_id", "block_ix", F.when(level.isNotNull(), "heading").otherwise("paragraph").alias("kind"), level.alias("level"), "text")


BLOCKS = f"select doc_id, block_ix, case when block_ix % 3 = 0 then 'heading' else 'paragraph' end as kind, case when block_ix % 3 = 0 then (block_ix // 3) % 3 end as level, text from ({LINES})"


@query(
    """select doc_id, replace(text, 'the ', 'that ') as text, cast((length(text) - length(replace(text, 'the ', ''))) // 4 as bigint) as n, cast(1 as bigint) as kept_prefix from documents where contains(text, 'the ')"""
    .replace("cast(1 as bigint) as kept_prefix", "cast(strpos(text, 'the ') + 1 as bigint) as prefix")
)
def replace_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal replacement and how much of each text before it stays as it was."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("the ")))
    new = F.replace("text", F.lit("the "), F.lit("that "))
    return docs.select("doc_id", new.alias("text"), ft.literal_count(F.col("text"), "the ").alias("n"), (F.instr("text", "the ") + 1).cast("bigint").alias("prefix"))


@query(
    """with p as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as prev from conversations),
l as (select *, least(length(text), length(prev)) as most from p where prev is not null)
select conv_id, turn, coalesce((select min(i) - 1 from unnest(range(1, most + 1)) u(i) where substr(text, i, 1) <> substr(prev, i, 1)), most) as prefix from l"""
)
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that consecutive turns start with alike."""
    c = table(spark, sf_dir, "conversations")
    p = c.withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("prev is not null")
    return p.select("conv_id", "turn", ft.common_prefix(F.col("text"), F.col("prev")).alias("prefix"))


@query(
    f"""with b as ({BLOCKS}), h as (select doc_id, count(*) filter (where contains(text, 'and')) as n from b group by doc_id)
select doc_id, block_ix, kind, level, case when n = 1 and contains(text, 'and') then 'changed' else text end as text from b join h using (doc_id)"""
)
def set_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the only block that holds a word; documents where it isn't the only one stay."""
    return edits.apply(_blocks(spark, sf_dir), [edits.Op("set_text", {"block": "and", "text": "changed"})])[0]


@query(
    f"""with b as ({BLOCKS}), n as (select doc_id, count(*) as n from b group by doc_id)
select doc_id, cast(case when n > 4 and block_ix > 2 then block_ix - 2 else block_ix end as integer) as block_ix, kind, level, text from b join n using (doc_id) where n <= 2 or not block_ix between 1 and 2""".replace("n > 4 and block_ix > 2", "n > 2 and block_ix > 2").replace("where n <= 2", "where n < 3")
)
def delete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks 1 to 2 go; documents without them stay."""
    return edits.apply(_blocks(spark, sf_dir), [edits.Op("delete", {"block": 1, "to": 2})])[0]


@query(
    f"""with b as ({BLOCKS}), n as (select doc_id, count(*) as n, min(case when block_ix > 3 and level <= 1 then block_ix end) as z, max(case when block_ix = 3 then level end) as l from b group by doc_id),
m as (select doc_id, n, coalesce(z, n) as z, l is null as bad from n)
select doc_id, cast(case when not bad and block_ix >= z then block_ix - (z - 3) else block_ix end as integer) as block_ix, kind, level, text from b join m using (doc_id) where bad or not (block_ix >= 3 and block_ix < z)"""
)
def delete_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that block 3 heads goes."""
    return edits.apply(_blocks(spark, sf_dir), [edits.Op("delete_section", {"heading": 3})])[0]


@query(
    f"""with b as ({BLOCKS}), n as (select doc_id, count(*) as n from b group by doc_id)
select doc_id, cast(case when n < 4 then block_ix when block_ix = 0 then 2 when block_ix <= 2 then block_ix - 1 else block_ix end as integer) as block_ix, kind, level, text from b join n using (doc_id)""".replace("n < 4", "n < 3")
)
def move_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block moves behind block 2."""
    return edits.apply(_blocks(spark, sf_dir), [edits.Op("move", {"block": 0, "after": 2})])[0]


@query(
    f"""with b as ({BLOCKS}), a as (
  select doc_id, block_ix * 10 as k, kind, level, text from b where block_ix <> 1
  union all select doc_id, 5, kind, null, 'first new' from b where block_ix = 0
  union all select doc_id, 6, kind, null, 'second new' from b where block_ix = 0), n as (select doc_id, count(*) as n from b group by doc_id)
select doc_id, cast(row_number() over (partition by doc_id order by k) - 1 as integer) as block_ix, kind, level, text from a join n using (doc_id) where n > 1
union all select doc_id, block_ix, kind, level, text from b join n using (doc_id) where n = 1"""
)
def insert_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block 1 goes and two new ones come behind the first; each op sees what the one before left."""
    ops = [edits.Op("delete", {"block": 1}), edits.Op("insert", {"after": 0, "text": ["first new", "second new"]})]
    return edits.apply(_blocks(spark, sf_dir), ops)[0]


@query(
    f"""with b as ({BLOCKS}), n as (select doc_id, sum((length(text) - length(replace(text, 'MIT', ''))) // 3) as n from b group by doc_id)
select doc_id, case when n = 1 then 1 else 0 end as changed, cast(case when n = 1 then -1 else 0 end as integer) as op_ix from n""".replace("cast(case when n = 1 then -1 else 0 end as integer) as op_ix", "cast(case when n <> 1 then 0 end as integer) as op_ix")
)
def batch_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a batch changes, and the op by which the others refuse it."""
    b = _blocks(spark, sf_dir)
    _, errors = edits.apply(b, [edits.Op("replace", {"find": "MIT", "replace": "BSD"}), edits.Op("page_break_before", {"block": 0})])
    return b.select("doc_id").distinct().join(errors, "doc_id", "left").select("doc_id", F.when(F.col("op_ix").isNull(), 1).otherwise(0).alias("changed"), "op_ix")


@query(
    f"""with b as ({BLOCKS}), o as (select doc_id, block_ix, text as old, replace(text, 'is ', 'was ') as new from b where contains(text, 'is ')),
x as (select doc_id, block_ix, 'replace' as kind, cast(strpos(old, 'is ') as bigint) as first_at from o) select x.doc_id, x.block_ix, x.kind, 'desk' as author from x"""
)
def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisions that a replacement leaves."""
    b = _blocks(spark, sf_dir)
    after = b.withColumn("text", F.replace("text", F.lit("is "), F.lit("was ")))
    return edits.revisions(b, after, "desk", "2026-01-01 00:00:00").select("doc_id", "block_ix", "kind", "author")


@query(
    """with u(o_orderkey, status) as (select o_orderkey, 'F' from orders where o_orderkey % 7 = 0) select o.o_orderkey, o.o_custkey, coalesce(u.status, o.o_orderstatus) as o_orderstatus from orders o left join u using (o_orderkey)"""
)
def cell_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by address: new values where an op names the row."""
    o = table(spark, sf_dir, "orders")
    ops = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("F").alias("status"))
    return o.join(ops, "o_orderkey", "left").select("o_orderkey", "o_custkey", F.coalesce("status", "o_orderstatus").alias("o_orderstatus"))


@query(
    """with r as (select o_custkey, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as bigint) as row_ix, o_totalprice as price from orders),
a as (select o_custkey, row_ix * 10 as k, price from r where row_ix <> 1 union all select distinct o_custkey, 5, cast(0 as double) from r)
select o_custkey, cast(row_number() over (partition by o_custkey order by k) - 1 as bigint) as row_ix, price from a"""
)
def add_del_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 1 of each table goes and a new one comes behind row 0."""
    rows = grids.renumbered(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "row_ix")
    kept = rows.where("row_ix <> 1").select("o_custkey", (F.col("row_ix") * 10).alias("k"), F.col("o_totalprice").alias("price"))
    new = rows.where("row_ix = 0").select("o_custkey", F.lit(5).cast("bigint").alias("k"), F.lit(0.0).alias("price"))
    return grids.renumbered(kept.unionByName(new), ["o_custkey"], ["k"], "row_ix").drop("k")


@query(
    """with c as (select o_orderkey, case when k = 0 then 0 when k = 1 then 1 else 3 end as col_ix, case k when 0 then o_orderstatus when 1 then o_orderpriority else cast(o_custkey as varchar) end as text from orders, unnest(range(0, 3)) u(k)),
n as (select * from c union all select o_orderkey, 2, '' from orders)
select o_orderkey, cast(col_ix - 1 as bigint) as col_ix, text from n where col_ix > 0"""
)
def add_del_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In cells of three columns: a blank column comes behind the second, and the first goes."""
    o = table(spark, sf_dir, "orders")
    cells = o.select("o_orderkey", F.posexplode(F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))).alias("c", "text"))
    moved = cells.select("o_orderkey", F.when(F.col("c") > 1, F.col("c") + 1).otherwise(F.col("c")).cast("bigint").alias("col_ix"), "text")
    new = o.select("o_orderkey", F.lit(2).cast("bigint").alias("col_ix"), F.lit("").alias("text"))
    return moved.unionByName(new).where("col_ix > 0").withColumn("col_ix", F.col("col_ix") - 1)


@query(
    """with r as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as row_ix, o_orderpriority as text from orders)
select o_custkey, cast(case when row_ix < 2 then 0 else row_ix end as bigint) as row_ix, string_agg(text, chr(10) order by r.row_ix) as text, count(*) as n from r group by o_custkey, case when row_ix < 2 then 0 else row_ix end""".replace("group by o_custkey, case", "group by o_custkey, case")
)
def merge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two rows of each column become one cell that holds both texts."""
    rows = grids.renumbered(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "row_ix")
    merged = rows.withColumn("target", F.when(F.col("row_ix") < 2, 0).otherwise(F.col("row_ix")).cast("bigint"))
    joined = merged.groupBy("o_custkey", "target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_ix", "o_orderpriority"))), lambda x: x["o_orderpriority"]), "\n").alias("text"), F.count("*").alias("n"))
    return joined.withColumnRenamed("target", "row_ix")


@query("select p_partkey, coalesce(case when p_size > 25 then 'bold' end, case when p_brand = 'Brand#1' then 'italic' end, p_type) as style, case when p_size % 2 = 0 then true when p_size % 3 = 0 then false end as toggle, cast(round_even(p_retailprice * 2, 0) as bigint) as halves from part")
def format_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only named properties change; a toggle is on, off or absent; sizes are whole half-points."""
    p = table(spark, sf_dir, "part")
    style = F.coalesce(F.when(F.col("p_size") > 25, F.lit("bold")), F.when(F.col("p_brand") == "Brand#1", F.lit("italic")), F.col("p_type"))
    toggle = F.when(F.col("p_size") % 2 == 0, True).when(F.col("p_size") % 3 == 0, False)
    return p.select("p_partkey", style.alias("style"), toggle.alias("toggle"), geo.points_to_halves(F.col("p_retailprice")).alias("halves"))


@query("select p_partkey, case when p_retailprice >= 1000 and p_retailprice < 1800 then p_retailprice + 50 else p_retailprice end as y from part")
def open_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", geo.opened(F.col("p_retailprice"), 1000, 50, 1800).alias("y"))


@query("select p_partkey, case when p_retailprice >= 1100 and p_retailprice < 1800 then p_retailprice - 100 else p_retailprice end as y from part where not (p_retailprice >= 1000 and p_retailprice < 1100)")
def close_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", geo.closed(F.col("p_retailprice"), 1000, 1100, 1800).alias("y")).where("y is not null")


@query(
    """with t as (select page_id, row_number() over (order by page_id) as p from pages where page_id % 5 <> 4),
d as (select page_id, p, c from t, unnest(range(0, 2)) u(c) where c = 0 or page_id % 5 = 2)
select page_id, cast(c as bigint) as copy, cast(row_number() over (partition by page_id // 100 order by p, c) - 1 as bigint) as page_ix from d"""
)
def duplicate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some pages go, others are doubled right behind themselves, and each file of a hundred pages is numbered anew."""
    p = table(spark, sf_dir, "pages").where("page_id % 5 <> 4").withColumn("file", F.floor(F.col("page_id") / 100))
    copies = p.withColumn("copy", F.explode(F.when(F.col("page_id") % 5 == 2, F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))))
    return grids.renumbered(copies, ["file"], ["page_id", "copy"], "page_ix").select("page_id", "copy", "page_ix")


@query("select page_id, ((page_id * 90) % 360 + case when page_id % 3 = 0 then 90 else 0 end) % 360 as rotation from pages")
def rotate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    turned = (F.col("page_id") * 90) % 360 + F.when(F.col("page_id") % 3 == 0, 90).otherwise(0)
    return p.select("page_id", (turned % 360).alias("rotation"))


@query(
    """with r as (select conv_id, turn, cast(coalesce(sum(length(t)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as s, t from (select conv_id, turn, text as t from conversations))
select conv_id, turn, greatest(s, p.a) as start, least(s + length(t), p.z) as "end", p.m as matched from r, (values (0, 10, false), (10, 25, true), (25, 1000000000, false)) p(a, z, m) where greatest(s, p.a) < least(s + length(t), p.z)"""
)
def split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs cut where a match over characters 10 to 25 of their paragraph begins and ends."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("run_ix"), "text")
    size = F.length("text").cast("bigint")
    upto = F.sum(size).over(Window.partitionBy("conv_id").orderBy("run_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = c.withColumn("end", upto).withColumn("start", F.col("end") - size)
    spans = c.select("conv_id").distinct().select("conv_id", F.lit(10).cast("bigint").alias("m0"), F.lit(25).cast("bigint").alias("m1"))
    return edits.split_runs(runs, spans, ["conv_id"]).select("conv_id", F.col("run_ix").alias("turn"), "start", "end", "matched")


@query(f"with b as ({BLOCKS}) select count(*) as n_blocks, cast(0 as bigint) as n_changed from b")
def roundtrip_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit and its inverse leave every block as it was."""
    b = _blocks(spark, sf_dir)
    there, _ = edits.apply(b, [edits.Op("move", {"block": 0, "after": 1}), edits.Op("move", {"block": 1, "before": 0})])
    changed = b.exceptAll(there.select(*b.columns)).unionAll(there.select(*b.columns).exceptAll(b)).agg(F.count("*").alias("n_changed"))
    return b.select(F.lit(1).alias("k")).groupBy("k").agg(F.count("*").alias("n_blocks")).join(changed.withColumn("k", F.lit(1)), "k").drop("k")
