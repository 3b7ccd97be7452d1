"""Queries on page records: boxes, page texts, object graphs, fonts, ids, coverage, and plans of replacements and insertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import geometry as geo
from folio.functions import text as ft
from folio.operators import graphs, layout, lookup, select
from folio.plans.registry import checkpointed, query, table
from folio.sources import blocks as src


@query("select conv_id, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' order by turn) as text from conversations group by conv_id".replace("\\\\", "\\"))
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of pages, white space collapsed, in the order of their blocks."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", ft.collapsed(F.col("text")).alias("text")).alias("t"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["text"]), " ").alias("text"))


@query(
    """with b as (select p_partkey // 50 as page, 'span' as kind, p_size * 1.0 as x0, p_size + 10.0 as x1 from part where p_name <> ''
union all select s_suppkey // 50, 'image', s_nationkey * 1.0, s_nationkey + 5.0 from supplier union all select c_custkey // 50, 'drawing', c_nationkey * 1.0, c_nationkey * 1.0 from customer)
select page, kind, count(*) as n, cast(min(x0) as double) as x0, cast(max(x1) as double) as x1 from b where x0 < x1 group by page, kind"""
)
def content_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of spans, images and drawings together, empty ones left out, summed up by page and kind."""
    box = lambda df, key, kind, x0, x1: df.select(F.floor(F.col(key) / 50).alias("page"), F.lit(kind).alias("kind"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"))
    size, s, c = F.col("p_size"), F.col("s_nationkey"), F.col("c_nationkey")
    boxes = box(table(spark, sf_dir, "part").where("p_name <> ''"), "p_partkey", "span", size, size + 10)
    boxes = boxes.unionByName(box(table(spark, sf_dir, "supplier"), "s_suppkey", "image", s, s + 5)).unionByName(box(table(spark, sf_dir, "customer"), "c_custkey", "drawing", c, c))
    return boxes.where("x0 < x1").groupBy("page", "kind").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(
    """with recursive e as (select distinct cast(s_nationkey * 37 + 1 as bigint) as a, s_suppkey as b from supplier union select distinct s_suppkey, s_suppkey // 2 from supplier),
r(start, node) as (select a, b from e where a <= 112 union select r.start, e.b from r join e on e.a = r.node) select start, count(*) as n, max(node) as furthest from r group by start"""
)
def form_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a few roots reach over references, each object once, however references loop."""
    s = table(spark, sf_dir, "supplier")
    e = s.select((F.col("s_nationkey") * 37 + 1).cast("bigint").alias("a"), F.col("s_suppkey").alias("b")).union(s.select("s_suppkey", F.floor(F.col("s_suppkey") / 2))).distinct()
    reached = graphs.reachable(e, e.where("a <= 112").select(F.col("a").alias("start")).distinct(), cut=checkpointed)
    return reached.groupBy("start").agg(F.count("*").alias("n"), F.max("node").alias("furthest"))


@query(
    """with f as (select p_brand as family, p_size % 2 = 0 as bold, p_size % 3 = 0 as italic, p_partkey as file, case when p_partkey % 4 = 0 then 0 else 1 end as priority from part),
r as (select *, row_number() over (partition by family, bold, italic order by priority, file) as k from f) select family, bold, italic, file from r where k = 1"""
)
def font_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each family and style: bundled before system ones, the first of equals."""
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_brand").alias("family"), (F.col("p_size") % 2 == 0).alias("bold"), (F.col("p_size") % 3 == 0).alias("italic"), F.col("p_partkey").alias("file"), F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(1).alias("priority"))
    return lookup.best(f, ["family", "bold", "italic"], [F.col("priority"), F.col("file")]).drop("priority")


@query("select conv_id, coalesce(max(turn), 0) + 1 as next_id, coalesce(max(turn) filter (where role = 'nobody'), 0) + 1 as first_id from conversations group by conv_id")
def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more than the largest id, 1 where there is none."""
    most = lambda c: F.coalesce(F.max(c), F.lit(0)) + 1
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(most("turn").alias("next_id"), most(F.when(F.col("role") == "nobody", F.col("turn"))).alias("first_id"))


@query("select vec_id, list_sum(list_transform(embedding, lambda v: case when abs(cast(floor((v + 1) * 127) as integer) - 127) <= 12 then 1 else 0 end)) / cast(len(embedding) as double) as share, list_sum(list_transform(embedding, lambda v: case when abs(cast(floor((v + 1) * 127) as integer) - 127) <= 12 then 1 else 0 end)) / cast(len(embedding) as double) >= 0.35 as filled from embeddings")
def fill_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of grey values within 12 of the middle, and whether it is enough to count as a fill."""
    e = table(spark, sf_dir, "embeddings")
    near = F.aggregate("embedding", F.lit(0), lambda n, v: n + F.when(F.abs(F.floor((v + 1) * 127).cast("int") - 127) <= 12, 1).otherwise(0))
    return e.select("vec_id", (near / F.size("embedding")).alias("share")).withColumn("filled", F.col("share") >= 0.35)


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ix, count(*) over (partition by o_custkey) as n from orders) select o_orderkey, n <= 8 or ix < 4 or ix >= n - 3 as keep from r")
def keep_with_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay with the next one: all of a short table, the first four and the last three of a long one."""
    w = Window.partitionBy("o_custkey")
    r = table(spark, sf_dir, "orders").select("o_orderkey", (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("ix"), F.count("*").over(w).alias("n"))
    return r.select("o_orderkey", ((F.col("n") <= 8) | (F.col("ix") < 4) | (F.col("ix") >= F.col("n") - 3)).alias("keep"))


@query("select o_orderkey, list_contains(['table', 'row', 'col'], k1) and list_contains(['table', 'row', 'col'], k2) as address, k1 in ('ins', 'del') or k2 in ('ins', 'del') as in_deletion from (select o_orderkey, case o_orderkey % 3 when 0 then 'table' when 1 then 'ins' else 'row' end as k1, case o_orderkey % 2 when 0 then 'col' else 'para' end as k2 from orders) x")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an address names only known keys, and whether its path runs through a deletion."""
    k1 = F.when(F.col("o_orderkey") % 3 == 0, "table").when(F.col("o_orderkey") % 3 == 1, "ins").otherwise("row")
    keys = F.array(k1, F.when(F.col("o_orderkey") % 2 == 0, "col").otherwise("para"))
    known, dead = (F.array(*map(F.lit, x)) for x in (("table", "row", "col"), ("ins", "del")))
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.size(F.array_except(keys, known)) == 0).alias("address"), F.arrays_overlap(keys, dead).alias("in_deletion"))


@query("select conv_id, turn, 'в' || chr(160) || 'доме ' || turn || chr(8239) || 'кг' || chr(160) || '— и' || chr(160) || role || ' ' || (turn * 5) || chr(8239) || '%' as text from conversations")
def glued_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short words, units and dashes tied to their neighbours."""
    c = table(spark, sf_dir, "conversations")
    plain = F.concat(F.lit("в доме "), F.col("turn").cast("string"), F.lit(" кг — и "), "role", F.lit(" "), (F.col("turn") * 5).cast("string"), F.lit(" %"))
    return c.select("conv_id", "turn", ft.glued(plain).alias("text"))


@query(
    """with m as (select doc_id, cast((length(text) - length(replace(text, 'MIT', ''))) // 3 as bigint) as n, contains(text, '|') as piped from documents)
select doc_id, n, case when n = 0 then 'absent' when n > 1 then 'count' when piped then 'table' else 'ok' end as verdict, bool_and(n = 1 and not piped) over () as all_ok from m where n > 0"""
)
def replace_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each place of a replacement, and whether all may go ahead."""
    docs = select.counted(table(spark, sf_dir, "documents"), "MIT")
    m = docs.join(table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("|")).alias("piped")), "doc_id")
    verdict = F.when(F.col("n") == 0, "absent").when(F.col("n") > 1, "count").when(F.col("piped"), "table").otherwise("ok")
    flagged = m.select("doc_id", "n", verdict.alias("verdict"))
    whole = flagged.agg(F.bool_and(F.col("verdict") == "ok").alias("all_ok")).withColumn("k", F.lit(1))
    # One row, so it can be broadcast.
    return flagged.withColumn("k", F.lit(1)).join(F.broadcast(whole), "k").drop("k")


@query(
    """with recursive w as (select item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as a from benchmark),
f as (select item_id, a, 0 as i, 0 as cur, 0 as lines from w union all
  select item_id, a, i + 1, case when cur > 0 and cur + 1 + length(a[i + 1]) <= 50 then cur + 1 + length(a[i + 1]) else length(a[i + 1]) end, case when cur > 0 and cur + 1 + length(a[i + 1]) <= 50 then lines else lines + 1 end from f where i < len(a)),
l as (select item_id, max(lines) as lines from f where i = len(a) group by item_id)
select item_id, cast(list_max(list_transform(a, lambda x: length(x))) as bigint) as widest, list_max(list_transform(a, lambda x: length(x))) <= 50 and lines > 0 and lines * 12 <= 80 as fits from w join l using (item_id)""".replace("\\\\", "\\")
)
def insert_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether whole passages fit a rectangle of 300 by 80 unshrunk: widths by the character model, heights by the wrap."""
    b = table(spark, sf_dir, "benchmark")
    widest = F.array_max(F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), F.length)).cast("bigint")
    lines = layout.wrapped(F.col("text"), 50)
    ok = geo.valid_rectangle(F.lit(0.0), F.lit(0.0), F.lit(300.0), lines * 12.0, 300, 80)
    return b.select("item_id", widest.alias("widest"), ok.alias("fits"))


@query("select word_ix, word, count(*) as n from (select cast(g - 1 as integer) as word_ix, a[g] as word from (select list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as a from conversations) c, unnest(range(1, least(len(a), 3) + 1)) u(g)) x group by 1, 2".replace("\\\\", "\\"))
def leading_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three words of blocks and how often each leads."""
    w = src.words(table(spark, sf_dir, "conversations").withColumn("k", F.struct("conv_id", "turn")), "k")
    return w.where("word_ix < 3").groupBy("word_ix", "word").agg(F.count("*").alias("n"))


@query(
    """with w as (select distinct p_brand as family, p_size % 2 = 0 as bold from part), e as (select p_brand as family, p_size % 2 = 0 as bold, 'embedded ' || min(p_partkey) as file from part where p_partkey % 41 = 0 group by 1, 2),
a as (select 'Brand#' || (n_nationkey + 10) as family, 'Brand#' || (n_nationkey % 5 + 20) as other from nation), y as (select p_brand as family, p_size % 2 = 0 as bold, 'system ' || min(p_partkey) as file from part where p_partkey % 13 = 0 group by 1, 2),
i as (select p_brand as family, 'indexed ' || min(p_partkey) as file from part where p_partkey % 3 = 0 group by 1)
select w.family, w.bold, coalesce(e.file, y.file, i.file) as file from w left join e on e.family = w.family and e.bold = w.bold left join (select family, min(other) as other from a group by family) a on a.family = w.family left join y on y.family = coalesce(a.other, w.family) and y.bold = w.bold left join i on i.family = w.family"""
)
def font_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each family and style: one embedded in the document, else a system one by a table of families, else any that is indexed."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), (F.col("p_size") % 2 == 0).alias("bold"), "p_partkey")
    wanted = p.select("family", "bold").distinct()
    n = table(spark, sf_dir, "nation")
    other = n.select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 10).cast("string")).alias("family"), F.concat(F.lit("Brand#"), (F.col("n_nationkey") % 5 + 20).cast("string")).alias("other")).groupBy("family").agg(F.min("other").alias("other"))
    file = lambda df, kind, *by: df.groupBy(*by).agg(F.concat(F.lit(kind + " "), F.min("p_partkey").cast("string")).alias("file"))
    named = wanted.join(other, "family", "left").withColumn("system", F.coalesce("other", "family"))
    embedded = file(p.where("p_partkey % 41 = 0"), "embedded", "family", "bold").join(wanted, ["family", "bold"])
    system = file(p.where("p_partkey % 13 = 0"), "system", "family", "bold").withColumnRenamed("family", "system").join(named, ["system", "bold"])
    indexed = file(p.where("p_partkey % 3 = 0"), "indexed", "family").join(wanted, "family")
    sources = [df.select("family", "bold", "file", F.lit(k).alias("priority")) for k, df in enumerate((embedded, system, indexed))]
    every = sources[0].unionByName(sources[1]).unionByName(sources[2])
    return wanted.join(lookup.best(every, ["family", "bold"], [F.col("priority")]).drop("priority"), ["family", "bold"], "left").select("family", "bold", "file")
