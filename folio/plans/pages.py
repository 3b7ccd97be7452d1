"""Queries on page guards and row edits. Spans are order lines as in the gate's queries: eight orders are a document's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import geometry as geo
from folio.operators import content, layout, lookup, pages
from folio.plans.gating import SPANS, _spans
from folio.plans.registry import query, table
from folio.sources import blocks as src

#: A band of each page with what it is for, and a cut.
BANDS = "select distinct doc_id, page, 100.0 + page % 5 * 60 as top, 130.0 + page % 5 * 60 as bottom, cast(40 as double) as x0, cast(300 as double) as x1, cast(760 as double) as floor from s"


def _laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).withColumn("baseline", F.col("y1") - 3)


def _bands(spans: DataFrame) -> DataFrame:
    top = 100.0 + F.col("page") % 5 * 60
    return spans.select("doc_id", "page").distinct().select("doc_id", "page", top.alias("top"), (top + 30.0).alias("bottom"), F.lit(40.0).alias("x0"), F.lit(300.0).alias("x1"), F.lit(760.0).alias("floor"))


FOREIGN = "select s.doc_id, s.page, 'other content: ' || substr(s.text, 1, 30) as reason from s join b on b.doc_id = s.doc_id and b.page = s.page where s.y1 - 3 > b.top + 0.3 and s.y1 - 3 < b.bottom - 0.3 and not (s.x0 >= b.x0 - 12 and s.x1 <= b.x1 + 12)"


@query(f"with s as ({SPANS}), b as ({BANDS}) {FOREIGN}")
def band_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text beside the row that a band is for."""
    s = _laid(spark, sf_dir)
    return pages.foreign_in_band(s, _bands(s))


@query(f"with s as ({SPANS}), b as ({BANDS}) select s.doc_id, s.page, 'cuts through: ' || substr(s.text, 1, 30) as reason from s join b on b.doc_id = s.doc_id and b.page = s.page where b.top > s.y0 + 0.25 * (s.y1 - s.y0) and b.top < s.y1 - 3 - 0.5")
def cut_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a cut at the upper end of a band would go through."""
    s = _laid(spark, sf_dir)
    return pages.sliced(s, _bands(s).withColumn("y", F.col("top")))


@query(f"with s as ({SPANS}), b as ({BANDS}) select s.doc_id, s.page, s.text as word, count(*) as n from s join b on b.doc_id = s.doc_id and b.page = s.page where (s.x0 + s.x1) / 2 between b.x0 and b.x1 and (s.y0 + s.y1) / 2 between b.top and b.bottom group by 1, 2, 3")
def words_in_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edit of a rectangle may remove."""
    s = _laid(spark, sf_dir)
    rects = _bands(s).withColumns({"y0": F.col("top"), "y1": F.col("bottom")})
    return pages.words_inside(s.withColumnRenamed("text", "word"), rects)


@query(f"with s as ({SPANS}), b as ({BANDS}) select distinct s.doc_id, s.page, 'form field' as reason from s join b on b.doc_id = s.doc_id and b.page = s.page where s.x0 < b.x1 and b.x0 < s.x1 and s.y0 < b.bottom and b.top < s.y1")
def field_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a replacement over a form field."""
    s = _laid(spark, sf_dir)
    return pages.over_fields(s, _bands(s).withColumns({"y0": F.col("top"), "y1": F.col("bottom")}))


@query(
    f"""with s as ({SPANS}), b as ({BANDS}), j as (select s.doc_id, s.page, l_partkey, x0_ as x0, s.y0, s.y1, b.top, b.bottom, b.floor from (select *, x0 as x0_ from s) s join b on b.doc_id = s.doc_id and b.page = s.page)
select doc_id, page, l_partkey, x0, case when y0 >= top and y0 < bottom then top when y0 >= bottom and y0 < floor then y0 - (bottom - top) else y0 end as y0,
case when y1 >= top and y1 < bottom then top when y1 >= bottom and y1 < floor then y1 - (bottom - top) else y1 end as y1 from j where not ((y0 + y1) / 2 >= top and (y0 + y1) / 2 < bottom)"""
)
def marks_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and comments after a band is taken out: some go, those below move up."""
    s = _laid(spark, sf_dir)
    return pages.remapped(s.select("doc_id", "page", "l_partkey", "x0", "y0", "y1"), _bands(s))


@query(
    f"""with s as ({SPANS}), w as (select distinct doc_id, page + 1 as page from s), p as (select distinct doc_id, page, case when (doc_id + page) % 7 = 0 then 90 else 0 end as rotation from s), t as (select distinct doc_id, page from s where page % 4 <> 1)
select w.doc_id, w.page, case when p.rotation is null then 'no such page' when p.rotation <> 0 then 'rotated' else 'no text' end as reason from w left join p on p.doc_id = w.doc_id and p.page = w.page left join t on t.doc_id = w.doc_id and t.page = w.page
where p.rotation is null or p.rotation <> 0 or t.doc_id is null"""
)
def page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named pages that can't be edited in place: the page after each one, some rotated, some without text."""
    s = _laid(spark, sf_dir)
    known = s.select("doc_id", "page").distinct()
    rotated = known.withColumn("rotation", F.when((F.col("doc_id") + F.col("page")) % 7 == 0, 90).otherwise(0))
    return pages.unusable(known.withColumn("page", F.col("page") + 1), rotated, s.where("page % 4 <> 1"))


@query(
    f"""with s as ({SPANS}), b as ({BANDS}), r as (select distinct doc_id, page from ({FOREIGN}) x), k as (select b.* from b left join r on r.doc_id = b.doc_id and r.page = b.page where r.doc_id is null)
select s.doc_id, s.page, s.l_partkey, s.x0, case when k.top is not null and s.y1 - 3 >= k.bottom and s.y1 - 3 < k.floor then s.y0 - (k.bottom - k.top) else s.y0 end as y0
from s left join k on k.doc_id = s.doc_id and k.page = s.page where k.top is null or not (s.y1 - 3 >= k.top and s.y1 - 3 < k.bottom)"""
)
def page_row_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's band is taken out and what is below moves up; pages where other text shares the band stay as they are."""
    s = _laid(spark, sf_dir)
    bands = _bands(s)
    out = pages.closed(s, bands, pages.foreign_in_band(s, bands))
    return out.select("doc_id", "page", "l_partkey", "x0", "y0")


@query(
    """with x as (select vec_id, list_transform(embedding, lambda v: cast(floor((v + 1) * 127) as integer)) as p from embeddings), y as (select x.vec_id, x.p, n.p as q from x join x n on n.vec_id = x.vec_id + 1),
z as (select vec_id, list_sum(list_transform(range(1, 33), lambda i: case when abs(p[i + 8] - q[i + 4]) > 48 then 1 else 0 end)) / cast(32 as double) as share from y) select vec_id, share, share <= 0.0004 as same from z"""
)
def strip_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips of 32 grey values, shifted by four, of each vector and the next id's."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor((v + 1) * 127).cast("int")).alias("p"))
    joined = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    share = pages.strip_difference(F.col("p"), F.col("q"), 8, 4, 32)
    return joined.select("vec_id", share.alias("share")).withColumn("same", pages.strips_equal(F.col("share")))


#: The first line of each page, and the room that a line of 14 points needs under it.
FIRST = "select *, row_number() over (partition by doc_id, page order by y0, x0, l_partkey, l_suppkey, l_extendedprice) as k from s"
GAPS = "select doc_id, page, y1 as y, cast(14 as double) as height, cast(810 as double) as floor, x0 as fx, y0 as fy from f where k = 1"
NO_ROOM = "select g.doc_id, g.page from g left join s on s.doc_id = g.doc_id and s.page = g.page group by g.doc_id, g.page, g.y, g.height, g.floor having coalesce(max(case when s.y1 - 3 >= g.y and s.y1 - 3 < g.floor then s.y1 end), g.y) + g.height > g.floor + 0.5"


def _first(s: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "l_partkey", "l_suppkey", "l_extendedprice")
    return s.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def _gaps(s: DataFrame) -> DataFrame:
    return _first(s).select("doc_id", "page", F.col("y1").alias("y"), F.lit(14.0).alias("height"), F.lit(810.0).alias("floor"))


@query(
    f"""with s as ({SPANS}), f as ({FIRST}), g as ({GAPS}), r as ({NO_ROOM}), a as (select g.* from g left join r on r.doc_id = g.doc_id and r.page = g.page where r.doc_id is null)
select s.doc_id, s.page, s.text, s.x0, case when a.y is not null and s.y1 - 3 >= a.y and s.y1 - 3 < a.floor then s.y0 + 14 else s.y0 end as y0 from s left join a on a.doc_id = s.doc_id and a.page = s.page
union all select doc_id, page, 'added', fx, fy + 14 from a"""
)
def page_row_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row like each page's first one under it; what is below moves down, pages without room stay as they are."""
    s = _laid(spark, sf_dir)
    gaps = _gaps(s)
    refused = pages.without_room(s, gaps)
    moved = pages.opened(s, gaps, refused).select("doc_id", "page", "text", "x0", "y0")
    new = _first(s).join(refused, ["doc_id", "page"], "left_anti").select("doc_id", "page", F.lit("added").alias("text"), "x0", (F.col("y0") + 14).alias("y0"))
    return moved.unionAll(new)


@query(f"with s as ({SPANS}), f as ({FIRST}), g as ({GAPS}) select doc_id, page, 'no room' as reason from ({NO_ROOM}) x")
def page_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without room for another line."""
    s = _laid(spark, sf_dir)
    return pages.without_room(s, _gaps(s))


CELLS_ = f"""with s as ({SPANS}), c as (select *, case when l_partkey % 3 = 0 then '' when l_partkey % 3 = 1 then 'short' else repeat('long text ', cast(l_partkey % 7 as integer)) end as new, case when l_suppkey % 3 = 0 then 'left' when l_suppkey % 3 = 1 then 'right' else 'center' end as align from s where l_partkey % 5 = 0),
w as (select *, length(new) * size * 0.5 as wd from c), p as (select *, case align when 'right' then x1 - wd when 'center' then (x0 + x1 - wd) / 2 else x0 end as nx from w), q as (select *, new <> '' and (nx < 20 - 0.5 or nx + wd > 575 + 0.5) as wide from p)"""


def _new_cells(s: DataFrame) -> DataFrame:
    new = F.when(F.col("l_partkey") % 3 == 0, "").when(F.col("l_partkey") % 3 == 1, "short").otherwise(F.repeat(F.lit("long text "), (F.col("l_partkey") % 7).cast("int")))
    align = F.when(F.col("l_suppkey") % 3 == 0, "left").when(F.col("l_suppkey") % 3 == 1, "right").otherwise("center")
    return s.where("l_partkey % 5 = 0").select("doc_id", "page", "span_ix", new.alias("text"), align.alias("align"), F.lit(20.0).alias("left"), F.lit(575.0).alias("right"))


def _indexed(s: DataFrame) -> DataFrame:
    return s.withColumn("span_ix", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


@query(
    CELLS_
    + """ select doc_id, page, case when wide then text else new end as text, case when wide then x0 else nx end as x0 from q where wide or new <> '' union all select doc_id, page, text, x0 from s where l_partkey % 5 <> 0"""
)
def page_cells_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New texts of some cells, placed by their alignment; empty ones take the span away, ones that don't fit change nothing."""
    s = _indexed(_laid(spark, sf_dir))
    return pages.set_cells(s, _new_cells(s))[0].select("doc_id", "page", "text", "x0")


@query(CELLS_ + " select doc_id, page, 'text doesn''t fit its column' as reason from q where wide")
def page_cells_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _indexed(_laid(spark, sf_dir))
    return pages.set_cells(s, _new_cells(s))[1]


@query(
    """with r as (select conv_id // 4 as doc_id, conv_id % 4 + 1 as page, turn as row_ix, role || ' ' || turn || '   ' || length(text) as a, role || ' | ' || turn || ' | ' || length(text) as b from conversations),
n as (select doc_id, page, row_ix, trim(regexp_replace(a, '\\s+', ' ', 'g')) as a, b from r),
s as (select distinct doc_id, page, unnest(['user 0', 'assistant | 1', 'user  2', 'nobody', '']) as selector from r),
w as (select *, trim(regexp_replace(selector, '\\s+', ' ', 'g')) as t from s)
select w.doc_id, w.page, w.selector, count(*) filter (where w.t <> '' and (contains(n.a, w.t) or contains(n.b, w.t))) as n, case when count(*) filter (where w.t <> '' and (contains(n.a, w.t) or contains(n.b, w.t))) = 1 then min(n.row_ix) filter (where w.t <> '' and (contains(n.a, w.t) or contains(n.b, w.t))) end as row_ix
from w left join n on n.doc_id = w.doc_id and n.page = w.page group by w.doc_id, w.page, w.selector""".replace("\\\\", "\\")
)
def row_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows named by their cells' texts, joined by blanks or by pipes; only one row may hold them."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.floor(F.col("conv_id") / 4).alias("doc_id"), (F.col("conv_id") % 4 + 1).alias("page"), F.col("turn").alias("row_ix"), F.array(F.col("role"), F.col("turn").cast("string"), F.length("text").cast("string")).alias("cells"))
    wanted = F.explode(F.array(*map(F.lit, ("user 0", "assistant | 1", "user  2", "nobody", ""))))
    return pages.selected_rows(rows, rows.select("doc_id", "page").distinct().select("doc_id", "page", wanted.alias("selector")))


@query(
    f"""with s as ({SPANS}), b as (select doc_id, page, cast(floor(y0 / 100) as bigint) as block_ix, min(y0) as y0, max(y1) as y1, count(distinct y0) as lines from s group by 1, 2, 3), c as (select doc_id, page, min(block_ix) as block_ix from b group by 1, 2),
e as (select o.doc_id, o.page, o.block_ix, o.y0, o.y1, o.lines, min(case when b.block_ix <> o.block_ix and b.y0 >= o.y1 - 0.5 then b.y0 end) as nx, max(case when b.block_ix <> o.block_ix and b.y1 <= o.y0 + 0.5 then b.y1 end) as pv from b o join c using (doc_id, page, block_ix) join b on b.doc_id = o.doc_id and b.page = o.page group by 1, 2, 3, 4, 5, 6)
select doc_id, page, block_ix, case when coalesce(nx - y1 < 3 * (y1 - y0) / lines, false) then y0 else coalesce(pv, y0) end as top, case when coalesce(nx - y1 < 3 * (y1 - y0) / lines, false) then nx else y1 end as bottom from e"""
)
def page_block_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes when each page's first block is deleted: it and the space that belongs to it."""
    s = _laid(spark, sf_dir)
    blocks = s.groupBy("doc_id", "page", F.floor(F.col("y0") / 100).alias("block_ix")).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.countDistinct("y0").alias("lines"))
    return pages.block_bands(blocks, blocks.groupBy("doc_id", "page").agg(F.min("block_ix").alias("block_ix")))


@query(
    """with recursive w as (select item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as a from benchmark),
f as (select item_id, a, 0 as i, 0 as cur, 0 as lines from w union all
  select item_id, a, i + 1, case when cur > 0 and cur + 1 + length(a[i + 1]) <= 60 then cur + 1 + length(a[i + 1]) else length(a[i + 1]) end, case when cur > 0 and cur + 1 + length(a[i + 1]) <= 60 then lines else lines + 1 end from f where i < len(a))
select item_id, cast(max(lines) * 13.5 + 6.0 as double) as text_gap, cast(least(item_id % 400 + 20.0, 300.0) as double) * 200 / 320 + 16 as image_gap from f where i = len(a) group by item_id""".replace("\\\\", "\\")
)
def page_insert_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of the gaps that an inserted paragraph and an inserted picture need on a page."""
    b = table(spark, sf_dir, "benchmark")
    text = layout.wrapped(F.col("text"), 60) * 13.5 + 6.0
    image = pages.picture_gap((F.col("item_id") % 400 + 20).cast("double"), F.lit(200.0), F.lit(320.0), F.lit(300.0))
    return b.select("item_id", text.alias("text_gap"), image.alias("image_gap"))


@query(
    f"""with s as ({SPANS}), f as ({FIRST}) select doc_id, page, l_partkey, cast(case when k = 1 then 12582912 end as bigint) as color, cast(case when k = 1 and l_partkey % 2 = 0 then 16776960 end as bigint) as fill from f"""
)
def page_row_coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of each page's first row; other rows keep theirs."""
    s = _laid(spark, sf_dir)
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "l_partkey", "l_suppkey", "l_extendedprice")
    first = F.row_number().over(w) == 1
    return s.withColumn("first", first).select("doc_id", "page", "l_partkey", F.when(F.col("first"), geo.hex_colour(F.lit("#c00000"))).alias("color"), F.when(F.col("first") & (F.col("l_partkey") % 2 == 0), geo.hex_colour(F.lit("ffff00"))).alias("fill"))


@query()
def content_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that content streams show, after saved states, nested matrices, leading and fill colours. Events are the ops; users the pages."""
    e = table(spark, sf_dir, "events")
    k, v = F.col("event_id") % 10, F.col("value").cast("double")
    names = F.array(*map(F.lit, ("q", "cm", "Tf", "TL", "Td", "rg", "Tj", "T*", "Q", "Tj")))
    numbers = F.array(v, v / 2, v % 3)
    args = F.when(k == 1, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5), F.lit(1.0), v % 7, v % 5)).when(k == 2, F.array(8 + v % 4)).when(k == 3, F.array(v % 9)).when(k == 4, F.array(v % 30, -(v % 11))).when(k == 5, F.transform(numbers, lambda x: x % 1)).otherwise(F.array().cast("array<double>"))
    ops = e.select(F.lit(0).alias("doc_id"), F.col("user_id").alias("page"), F.col("event_id").alias("seq"), F.element_at(names, (k + 1).cast("int")).alias("op"), args.alias("args"), F.col("event_type").alias("text"))
    return content.texts(ops)


@query(
    """with n as (select s_nationkey as page, s_suppkey as name, case when s_suppkey % 3 = 0 then s_name end as value, case when s_suppkey % 3 <> 0 then s_suppkey * 2 end as ref from supplier),
o as (select s_nationkey as page, s_suppkey * 2 as object, 'far ' || s_name as value from supplier where s_suppkey % 3 = 1)
select n.page, n.name, case when n.ref is null then n.value else o.value end as value from n left join o on o.page = n.page and o.object = n.ref"""
)
def resource_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named resources that stand in place or are objects of their own."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 3
    named = s.select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").alias("name"), F.when(k == 0, F.col("s_name")).alias("value"), F.when(k != 0, F.col("s_suppkey") * 2).alias("ref"))
    objects = s.where(k == 1).select(F.col("s_nationkey").alias("page"), (F.col("s_suppkey") * 2).alias("object"), F.concat(F.lit("far "), "s_name").alias("value"))
    return content.resolved(named, objects, ["page"])


@query(
    """with c as (select s_suppkey as tool, i as place, 'bin' || (s_suppkey * (i + 1) % 40) as path from supplier, unnest(range(0, 4)) u(i)), f as (select distinct 'bin' || n_nationkey as path from nation where n_nationkey % 2 = 0),
r as (select tool, path, row_number() over (partition by tool order by place) as k from c join f using (path)) select tool, path from r where k = 1"""
)
def tool_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tool the first of its candidate paths that there is."""
    s = table(spark, sf_dir, "supplier")
    c = s.select(F.col("s_suppkey").alias("tool"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place")).withColumn("path", F.concat(F.lit("bin"), (F.col("tool") * (F.col("place") + 1) % 40).cast("string")))
    files = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("bin"), F.col("n_nationkey").cast("string")).alias("path"))
    return content.first_existing(c, files, ["tool"])


@query(
    """with w as (select conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as a from conversations), e as (select conv_id, turn, i - 1 as word_ix, a[i] as word, length(a[i]) * 5.0 as wide from w, unnest(range(1, len(a) + 1)) u(i))
select conv_id, turn, cast(word_ix as integer) as word_ix, word, cast(72 + coalesce(sum(wide + 3) over (partition by conv_id, turn order by word_ix rows between unbounded preceding and 1 preceding), 0) as double) as x from e""".replace("\\\\", "\\")
)
def typeset_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each word of a line starts when it is set word by word in 10 points with spaces of 3."""
    c = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    w = src.words(c, "key").select("key.conv_id", "key.turn", "word_ix", "word").withColumn("wide", pages.text_width(F.col("word"), F.lit(10.0)) + 3)
    x = lookup.running(w, ["conv_id", "turn"], ["word_ix"], F.col("wide"), "x")
    return x.select("conv_id", "turn", "word_ix", "word", (F.col("x") + 72.0).alias("x"))
