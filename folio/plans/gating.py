"""Queries on the gate's rules. Spans are laid out from order lines: a document is a customer's range of orders, a page an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as ft
from folio.operators import gate
from folio.plans.registry import query, table

SPANS = """select l_orderkey // 8 as doc_id, l_orderkey % 8 + 1 as page, l_linenumber as n, 'line ' || l_partkey as text, 8 + l_discount * 100 as size,
l_tax * 4000 as x0, l_quantity * 16 as y0, l_tax * 4000 + 80 + l_discount * 2500 as x1, l_quantity * 16 + 12 as y1, l_partkey, l_suppkey, l_extendedprice from lineitem"""
PAGES = "select distinct l_orderkey // 8 as doc_id, l_orderkey % 8 + 1 as page, cast(595 as double) as width, cast(842 as double) as height from lineitem union all select distinct l_orderkey // 8, 9, 595.0, 842.0 from lineitem where l_orderkey // 8 % 3 = 0"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = F.col("l_tax") * 4000, F.col("l_quantity") * 16
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 8).alias("doc_id"), (F.col("l_orderkey") % 8 + 1).alias("page"), F.concat(F.lit("line "), F.col("l_partkey").cast("string")).alias("text"),
        (8 + F.col("l_discount") * 100).alias("size"), x0.alias("x0"), y0.alias("y0"), (x0 + 80 + F.col("l_discount") * 2500).alias("x1"), (y0 + 12).alias("y1"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with lines on them, and for every third document an empty last one."""
    filled = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("doc_id"), (F.col("l_orderkey") % 8 + 1).alias("page"))
    more = filled.where("doc_id % 3 = 0").select("doc_id", F.lit(9).cast("bigint").alias("page"))
    return filled.unionAll(more).distinct().select("doc_id", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))


#: Texts that trigger the rules which no table's texts do, and some that must not.
INJECTED = [(-1, "Total: {{ sum }}"), (-8, "Dear {{ name }}, TODO TBD"), (-9, "no text until here, which is far from both ends ??? as is this, more than thirty characters"), (-2, "todo: check"), (-3, "Lorem ipsum dolor"), (-4, "Error! Reference source not found"), (-5, "a clean line"), (-6, "a � glyph"), (-7, "a □ box")]
VALUES = ", ".join(f"({k}, '{t}')" for k, t in INJECTED)
PLACEHOLDER = ft.PLACEHOLDERS


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    injected = spark.createDataFrame(INJECTED, "doc_id long, text string")
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionAll(injected).withColumn("page", F.lit(1).cast("bigint"))


@query(
    f"""with t(doc_id, text) as (select doc_id, text from documents union all select * from (values {VALUES}) v(a, b)),
h as (select doc_id, text, regexp_extract_all(text, '(?i){PLACEHOLDER}') as hits, string_split_regex(text, '(?i){PLACEHOLDER}') as gaps from t where regexp_matches(text, '(?i){PLACEHOLDER}')),
p as (select doc_id, text, length(hits[i]) as n, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as bigint) as a from h, unnest(range(1, len(hits) + 1)) u(i))
select doc_id, substr(text, greatest(a - 30, 0) + 1, a + n + 30 - greatest(a - 30, 0)) as message from p"""
)
def placeholder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.placeholders(_texts(spark, sf_dir)).select("doc_id", "message")


@query(f"with t(doc_id, text) as (select doc_id, text from documents union all select * from (values {VALUES}) v(a, b)) select doc_id, text as message from t where contains(text, chr(65533)) or contains(text, chr(9633))")
def missing_glyph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.missing_glyphs(_texts(spark, sf_dir)).select("doc_id", "message")


@query(
    f"""with s as ({SPANS}), p as ({PAGES}), c as (select doc_id, round_even(size, 1) as size, count(*) as n from s group by 1, 2), m as (select doc_id, size as mode from (select *, row_number() over (partition by doc_id order by n desc, size) as k from c) x where k = 1),
l as (select *, row_number() over (partition by doc_id, page order by y1 desc, x0, text) as k from s), f as (select * from l where k = 1), z as (select doc_id, max(page) as last from p group by doc_id)
select f.doc_id, f.page, f.text as message from f join m using (doc_id) join z using (doc_id) where f.page < z.last and f.size > 1.15 * m.mode and f.y1 > 0.60 * 842"""
)
def stranded_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.stranded_headings(_spans(spark, sf_dir), _pages(spark, sf_dir)).select("doc_id", "page", "message")


@query(
    f"""with s as ({SPANS}), p as ({PAGES}), z as (select doc_id, max(page) as last from p group by doc_id), e as (select doc_id, page, max(y1) as e, max(y1) filter (where y1 < 0.90 * 842) as b from s group by 1, 2)
select doc_id, page, 'hole' as code from e join z using (doc_id) where page > 1 and page < last and b < 0.55 * 842 union all select doc_id, page, 'last_page' from e join z using (doc_id) where page = last and last > 1 and e < 0.15 * 842"""
)
def page_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.holes(_spans(spark, sf_dir), _pages(spark, sf_dir)).select("doc_id", "page", "code")


@query(
    f"""with s as ({SPANS}), r as (select doc_id, x1, row_number() over (partition by doc_id order by x1) as rn, count(*) over (partition by doc_id) as n from s), m as (select doc_id, max(case when rn = n - n // 20 then x1 end) as margin from r group by doc_id)
select s.doc_id, s.page, s.text as message from s join m using (doc_id) where s.x1 > m.margin + 36 and s.x1 > 595 - 20"""
)
def right_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.right_edge(_spans(spark, sf_dir), _pages(spark, sf_dir)).select("doc_id", "page", "message")


@query(f"with s as ({SPANS}) select doc_id, page, substr(text, 1, 30) as message from s where x0 < -2 or y0 < -2 or x1 > 597 or y1 > 844")
def out_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.outside(_spans(spark, sf_dir), _pages(spark, sf_dir)).select("doc_id", "page", "message")


@query(f"with s as ({SPANS}) select doc_id, page, 'drawing ' || min(l_partkey) as message from s where x0 < -2 or y0 < -2 or x1 > 597 or y1 > 844 group by doc_id, page")
def drawing_out_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawings = _spans(spark, sf_dir).withColumnRenamed("l_partkey", "draw_ix")
    return gate.drawings_outside(drawings, _pages(spark, sf_dir)).select("doc_id", "page", "message")


@query(f"with s as ({SPANS}), p as ({PAGES}) select doc_id, page, 'E' as severity from p where not exists (select 1 from s where s.doc_id = p.doc_id and s.page = p.page and s.y0 < 400)")
def blank_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose upper half holds nothing."""
    return gate.blank_pages(_pages(spark, sf_dir), _spans(spark, sf_dir).where("y0 < 400")).select("doc_id", "page", "severity")


LINES_ = f"""select doc_id, page, row_number() over (partition by doc_id, page order by y0, x0, x1, l_partkey, l_suppkey, l_extendedprice) as line_ix, x0, y0 * 0.3 as y0, x1, y0 * 0.3 + 10 + n % 4 as y1, text from ({SPANS})"""


@query(
    f"""with s as ({LINES_}) select a.doc_id, a.page, a.line_ix as a, b.line_ix as b from s a join s b on a.doc_id = b.doc_id and a.page = b.page and a.line_ix < b.line_ix
where least(a.y1 - a.y0, b.y1 - b.y0) >= 0.7 * greatest(a.y1 - a.y0, b.y1 - b.y0) and greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) > 0
and greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) > 0.3"""
)
def overprint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    ix = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "x1", "l_partkey", "l_suppkey", "l_extendedprice")).cast("bigint")
    lines = s.select("doc_id", "page", ix.alias("line_ix"), "x0", (F.col("y0") * 0.3).alias("y0"), "x1", (F.col("y0") * 0.3 + 10 + F.col("l_linenumber") % 4).alias("y1"), "text")
    return gate.overprinted(lines)


ROWS_ = "select conv_id // 4 as doc_id, conv_id % 4 + 1 as page, turn as row_ix, case when turn % 3 = 0 then 1 else 2 end as n_cells, case when turn = 1 then 'Item Amount' when turn = 4 and conv_id % 3 = 0 then 'Item Amount' else text end as text from conversations"


@query(
    f"""with recursive r as ({ROWS_}), h as (select doc_id, page - 1 as page, arg_min(text, row_ix) filter (where n_cells >= 2) as head, min(row_ix) filter (where n_cells >= 2) as hat, min(row_ix) as first from r group by doc_id, page),
f as (select r.doc_id, r.page, h.head, max(r.row_ix) as p from r join h on h.doc_id = r.doc_id and h.page = r.page where h.hat - h.first <= 1 and r.text = h.head group by 1, 2, 3),
a as (select doc_id, page, p, 0 as n, 0 as w, false as done from f union all
  select a.doc_id, a.page, r.row_ix, case when a.w > 4 then a.n when r.n_cells >= 2 then a.n + 1 else a.n end, case when a.w > 4 then a.w when r.n_cells >= 2 then 0 else a.w + 1 end, false from a join r on r.doc_id = a.doc_id and r.page = a.page and r.row_ix = a.p + 1)
select doc_id, page, arg_max(n, p) || ' row(s) before the break' as message from a group by doc_id, page having arg_max(n, p) < 3"""
)
def table_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that the next page repeats, with fewer than three rows left on the page before."""
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") == 1, "Item Amount").when((F.col("turn") == 4) & (F.col("conv_id") % 3 == 0), "Item Amount").otherwise(F.col("text"))
    rows = c.select(F.floor(F.col("conv_id") / 4).alias("doc_id"), (F.col("conv_id") % 4 + 1).alias("page"), F.col("turn").alias("row_ix"), F.when(F.col("turn") % 3 == 0, 1).otherwise(2).alias("n_cells"), text.alias("text"))
    return gate.split_tables(rows).select("doc_id", "page", "message")


@query(
    """with t as (select conv_id as doc_id, conv_id % 4 <> 0 as has_toc, string_agg('Chapter ' || turn || ' ' || repeat('.', cast(conv_id % 3 * 2 + turn % 4 as integer)) || ' ' || (turn * 7), chr(10) order by turn) as text from conversations group by conv_id)
select doc_id, 'contents are empty' as message from t where has_toc and len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\.{5,}\\s*\\d+\\s*$'))) < 2""".replace("\\\\", "\\")
)
def toc_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents whose lines mostly lack leaders of five dots."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("Chapter "), F.col("turn").cast("string"), F.lit(" "), F.repeat(F.lit("."), (F.col("conv_id") % 3 * 2 + F.col("turn") % 4).cast("int")), F.lit(" "), (F.col("turn") * 7).cast("string"))
    lines = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    heads = lines.select("doc_id", (F.col("doc_id") % 4 != 0).alias("has_toc"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"), F.lit(1).cast("bigint").alias("page"))
    return gate.contents_without_leaders(heads).select("doc_id", "message")


@query(
    """with s as (select conv_id as doc_id, turn as page from conversations), t as (select conv_id as doc_id, turn as page from conversations where turn < 6),
a as (select doc_id, count(*) as o from s group by 1), b as (select doc_id, count(*) as n from t group by 1) select doc_id, o || ' -> ' || coalesce(n, 0) as message, 'W' as severity from a full join b using (doc_id) where o is distinct from n"""
)
def page_count_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    return gate.page_counts(c, c.where("page < 6"), reflow=True).select("doc_id", "message", "severity")


@query(
    """with x as (select vec_id, list_transform(embedding, lambda v: cast(floor((v + 1) * 127) as integer)) as p, label from embeddings),
y as (select x.vec_id, x.p, n.p as q from x join x n on n.vec_id = x.vec_id + 1), z as (select vec_id, list_sum(list_transform(range(1, len(p) + 1), lambda i: case when abs(p[i] - q[i]) > 40 then 1 else 0 end)) / cast(len(p) as double) as share from y)
select vec_id, share, share > 0.0005 as changed from z"""
)
def raster_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as grey rasters, each against the next id's."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor((v + 1) * 127).cast("int")).alias("p"))
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    share = gate.raster_difference(F.col("p"), F.col("q"))
    return e.join(following, "vec_id").select("vec_id", share.alias("share"), (share > gate.PIXEL_SHARE).alias("changed"))


@query(
    """with f as (select doc_id, case when toxic = 1 then 'E' else 'W' end as s, 'q' || quality as m from labels), o as (select distinct m from f where s = 'E' and doc_id % 2 = 0),
k as (select doc_id, m from f where s = 'E' and doc_id % 2 = 0), g as (select f.doc_id, case when k.m is not null then 'W' else f.s end as s from f left join (select distinct doc_id, m from k) k on k.doc_id = f.doc_id and k.m = f.m),
c as (select doc_id, count(*) filter (where s = 'E') as errors, count(*) filter (where s = 'W') as warnings from g group by doc_id)
select d.doc_id, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(errors, 0) = 0 as passed from documents d left join c using (doc_id)"""
)
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts after errors that the original had, too, are downgraded."""
    found = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).cast("bigint").alias("page"), F.when(F.col("toxic") == 1, "E").otherwise("W").alias("severity"), F.lit("label").alias("code"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("message"))
    return gate.verdicts(table(spark, sf_dir, "documents").select("doc_id"), gate.downgraded(found, found.where("doc_id % 2 = 0")))


@query(
    """with f as (select doc_id, case when toxic = 1 then 'E' else 'W' end as s from labels), c as (select doc_id, count(*) filter (where s = 'E') as errors, count(*) filter (where s = 'W') as warnings from f group by doc_id)
select doc_id, '{"doc_id":' || doc_id || ',"errors":' || errors || ',"warnings":' || warnings || ',"passed":' || case when errors = 0 then 'true' else 'false' end || '}' as report from c"""
)
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as lines of JSON, as a results file has them."""
    found = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).cast("bigint").alias("page"), F.when(F.col("toxic") == 1, "E").otherwise("W").alias("severity"), F.lit("label").alias("code"), F.lit("label").alias("message"))
    verdicts = gate.verdicts(found.select("doc_id").distinct(), found)
    return verdicts.select("doc_id", F.to_json(F.struct("doc_id", "errors", "warnings", "passed")).alias("report"))
