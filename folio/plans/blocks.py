"""Queries on blocks, selectors, words and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as ft
from folio.operators import lookup, select
from folio.plans.registry import query, table
from folio.sources import blocks as src

LINES = "select d.doc_id, cast(g - 1 as integer) as block_ix, a[g] as text from (select doc_id, string_split(text, chr(10)) as a from documents) d, unnest(range(1, len(a) + 1)) u(g)"


@query(
    f"""with b as ({LINES})
select regexp_replace(text, '[0-9]+', '#', 'g') as line_key, count(distinct doc_id) as n_docs, count(*) as n_lines
from b group by 1 having count(distinct doc_id) >= 2"""
)
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur in two documents or more, numbers aside.

    Counting distinct documents as two aggregations keeps a hot line's rows from meeting in one task.
    """
    lines = src.text_blocks(table(spark, sf_dir, "documents")).withColumn("line_key", ft.digits_masked(F.col("text")))
    by_doc = lines.groupBy("line_key", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("line_key").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines")).where("n_docs >= 2")


@query(f"select doc_id, block_ix, cast(length(text) as bigint) as n_chars, case when length(text) > 90 then substr(text, 1, 90) || '…' else text end as preview from ({LINES})")
def blocks_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.text_blocks(table(spark, sf_dir, "documents"))
    return b.select("doc_id", "block_ix", F.length("text").cast("bigint").alias("n_chars"), ft.preview(F.col("text")).alias("preview"))


@query("select doc_id, cast((length(text) - length(replace(text, 'the ', ''))) / 4 as bigint) as n from documents where contains(text, 'the ')")
def find_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.counted(table(spark, sf_dir, "documents"), "the ")


@query(
    """with recursive hit as (
  select doc_id, text, cast(strpos(text, 'tion') as bigint) as p from documents where contains(text, 'tion')
  union all
  select doc_id, text, p + 3 + strpos(substr(text, p + 4), 'tion') from hit where contains(substr(text, p + 4), 'tion'))
select doc_id, count(*) as n, max(p - 1) as last_offset, cast(sum(p - 1) as bigint) as offset_sum from hit group by doc_id"""
)
def find_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a literal occurs, non-overlapping, summed up by document."""
    docs = table(spark, sf_dir, "documents")
    hits = docs.select("doc_id", F.explode(ft.literal_offsets(F.col("text"), "tion")).alias("at")).withColumn("at", F.col("at").cast("bigint"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("at").alias("last_offset"), F.sum("at").alias("offset_sum"))


HTML_PARTS = r"""with bare as (select page_id, regexp_replace(regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'gis'), '<([^a-zA-Z/!?])', '&lt;\1', 'g') as h from pages),
parts as (select page_id, list_filter(regexp_extract_all(h, '(?s)^[^<]+|<[/!?]?[a-zA-Z][^>]*>[^<]*'), lambda x: regexp_matches(x, '^<[a-zA-Z]') or trim(regexp_replace(x, '(?s)^<[^>]*>', '')) <> '') as a from bare),
"""
HTML = (
    HTML_PARTS
    + r"""blocks as (select page_id, cast(g - 1 as integer) as block_ix, lower(regexp_extract(a[g], '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag, trim(regexp_replace(a[g], '(?s)^<[^>]*>', '')) as text from parts, unnest(range(1, len(a) + 1)) u(g))"""
)


@query(HTML + " select page_id, block_ix, tag, case when regexp_matches(tag, '^h[1-6]$') then cast(substr(tag, 2, 1) as integer) - 1 end as level, text from blocks")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.html_blocks(table(spark, sf_dir, "pages"))


@query(
    """with l as (select conv_id, turn, role, text, regexp_extract(text, '^(#{1,6}) ', 1) as marks from (
  select conv_id, turn, role, case when role = 'user' then '## ' || text when turn % 3 = 0 then '- ' || text else text end as text from (select conv_id, turn, role, replace(text, chr(10), ' ') as text from conversations)))
select conv_id, turn, case when marks <> '' then 'heading' when regexp_matches(text, '^\\s*([-*+]|[0-9]+\\.) ') then 'list' when regexp_matches(text, '^> ?') then 'quote'
  when regexp_matches(text, '^\\s*\\|') then 'table' when regexp_matches(text, '^(---|\\*\\*\\*|___)\\s*$') then 'rule' else 'paragraph' end as kind,
  case when marks <> '' then cast(length(marks) as integer) end as level, cast(length(regexp_replace(text, '^(#{1,6} |\\s*(?:[-*+]|[0-9]+\\.) |> ?)', '')) as bigint) as n_chars
from l""".replace("\\\\", "\\")
)
def markdown_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations read as Markdown: questions as headings, some answers as list items."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    c = c.withColumn("text", F.when(F.col("role") == "user", F.concat(F.lit("## "), "text")).when(F.col("turn") % 3 == 0, F.concat(F.lit("- "), "text")).otherwise(F.col("text")))
    b = src.markdown_blocks(c.withColumn("k", F.struct("conv_id", "turn")), "k")
    return b.select("k.conv_id", "k.turn", "kind", "level", F.length("text").cast("bigint").alias("n_chars"))


@query(f"with b as ({LINES}) select doc_id, block_ix, cast(len(string_split(text, '|')) as bigint) as n_cells, list_aggregate(list_transform(string_split(text, '|'), lambda x: trim(x)), 'string_agg', '/') as row_text from b where contains(text, '|')")
def pipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.pipe_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "block_ix", F.size("cells").cast("bigint").alias("n_cells"), F.array_join("cells", "/").alias("row_text"))


@query("select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as op_ix, event_type as op, json_extract_string(props, '$.k') as k from events")
def json_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered op log with JSON arguments, numbered within each user."""
    log = table(spark, sf_dir, "events")
    numbered = log.withColumn("op_ix", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint") - 1)
    return numbered.select("user_id", "event_id", "op_ix", F.col("event_type").alias("op"), F.get_json_object("props", "$.k").alias("k"))


@query(
    """select b.item_id, count(d.doc_id) as n, count(d.doc_id) = 1 as ok, min(d.doc_id) as first_doc
from benchmark b left join documents d on contains(d.text, b.text) group by b.item_id"""
)
def selector_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as a selector that must match exactly one document."""
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("term"))
    hits = select.containing(table(spark, sf_dir, "documents"), terms)
    counted = hits.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return terms.join(counted, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) == 1).alias("ok"), "first_doc")


@query(
    """with h as (select b.item_id, d.doc_id, strpos(d.text, b.text) as p, row_number() over (partition by b.item_id order by d.doc_id) as k, d.text
  from benchmark b join documents d on contains(d.text, b.text))
select item_id, doc_id, cast(p - 1 as bigint) as "at", substr(text, greatest(p - 20, 1), 40) as context from h where k <= 5"""
)
def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five matches of each selector with 40 characters of context."""
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("term"))
    hits = select.first_matches(select.containing(table(spark, sf_dir, "documents"), terms), "item_id", ["doc_id"])
    at = F.instr("text", F.col("term"))
    return hits.select("item_id", "doc_id", (at - 1).cast("bigint").alias("at"), F.substring("text", F.greatest(at - 20, F.lit(1)), F.lit(40)).alias("context"))


@query(
    """with v as (select o_orderkey, case o_orderkey % 8 when 0 then cast(o_custkey % 20 as varchar) when 1 then '-' || (o_custkey % 20) when 2 then (o_custkey % 20) || '.5' when 3 then 'true' when 4 then null when 5 then '+' || (o_custkey % 20) when 6 then ' ' || (o_custkey % 20) else '-' || o_orderpriority end as raw from orders),
i as (select o_orderkey, raw, case when regexp_full_match(raw, '-?[0-9]+') then try_cast(raw as bigint) end as ix from v)
select o_orderkey, ix, case when ix between 0 and 7 then ix when ix between -8 and -1 then ix + 8 end as at from i"""
)
def strict_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only whole numbers are indexes; negative ones count from the end of eight."""
    n, k = (F.col("o_custkey") % 20).cast("string"), F.col("o_orderkey") % 8
    forms = [n, F.concat(F.lit("-"), n), F.concat(n, F.lit(".5")), F.lit("true"), F.lit(None).cast("string"), F.concat(F.lit("+"), n), F.concat(F.lit(" "), n), F.concat(F.lit("-"), "o_orderpriority")]
    ix = select.strict_index(F.element_at(F.array(*forms), (k + 1).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", ix.alias("ix")).withColumn("at", select.from_end(F.col("ix"), F.lit(8)))


@query(
    f"""with b as ({LINES}), r as (select doc_id, 1 as first, case when doc_id % 2 = 0 then 2 else 4 end as last from documents)
select b.doc_id, b.block_ix, cast(length(b.text) as bigint) as n_chars from b join r using (doc_id) where b.block_ix between r.first and r.last"""
)
def block_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranges = docs.select("doc_id", F.lit(1).alias("first"), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(4).alias("last"))
    found = select.in_ranges(src.text_blocks(docs), ranges, "doc_id")
    return found.select("doc_id", "block_ix", F.length("text").cast("bigint").alias("n_chars"))


@query("select doc_id, trim(regexp_replace(replace('  ' || text || chr(160) || chr(8201) || ' x' || chr(173) || 'y ', chr(173), ''), '[\\s\\x{00a0}\\x{2009}]+', ' ', 'g')) as text from documents".replace("\\\\", "\\"))
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with injected no-break and thin spaces and a soft hyphen, normalised."""
    docs = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("  "), "text", F.lit("   x­y "))
    return docs.select("doc_id", ft.collapsed(raw).alias("text"))


@query(
    """with w as (select unnest(regexp_extract_all(text, '[a-zA-Z]{5,}')) as word from documents)
select word, length(word) as n_chars, reverse(word) as marker from w group by word having count(*) = 1""".replace("length(word) as", "cast(length(word) as bigint) as")
)
def unique_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters or more that occur once, and their reversed markers."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{5,}"), F.lit(0))).alias("word"))
    once = words.groupBy("word").agg(F.count("*").alias("n")).where("n = 1")
    return once.select("word", F.length("word").cast("bigint").alias("n_chars"), F.reverse("word").alias("marker"))


@query(
    """select lang, count(*) as n, count(*) filter (where toxic = 0) as passed, count(*) filter (where toxic = 1) as refused, sum(quality) as quality
from documents join labels using (doc_id) group by lang""".replace("sum(quality)", "cast(sum(quality) as bigint)")
)
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage-by-verdict matrix: languages by label."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 0).alias("passed"), F.count_if(F.col("toxic") == 1).alias("refused"), F.sum("quality").alias("quality"))


@query(
    """with r as (select conv_id, turn, 'op ' || turn || ' (replace): ''' || substr(text, 1, 20) || ''' found ' || length(text) || ' times' as msg from conversations where role = 'user'),
k as (select substr(regexp_replace(regexp_replace(regexp_replace(msg, 'op \\d+ \\((\\w+)\\)', '\\1', 'g'), '''[^'']*''|"[^"]*"|\\[[^\\]]*\\]', '…', 'g'), '\\d+', 'N', 'g'), 1, 110) as reason, msg from r)
select reason, count(*) as n, min(msg) as example from k group by reason""".replace("\\\\", "\\")
)
def reason_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals grouped by their wording without particulars, with an example."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    msg = F.concat(F.lit("op "), F.col("turn").cast("string"), F.lit(" (replace): '"), F.substring("text", 1, 20), F.lit("' found "), F.length("text").cast("string"), F.lit(" times"))
    keyed = c.select(ft.reason_key(msg).alias("reason"), msg.alias("msg"))
    return keyed.groupBy("reason").agg(F.count("*").alias("n"), F.min("msg").alias("example"))


@query(
    """with recursive s as (select c_custkey as id, case when c_custkey % 50 = 7 then c_custkey + 3 else c_custkey - 1 end as parent, case when c_custkey % 17 = 0 then cast(c_nationkey % 9 as integer) end as outline from customer),
w(id, up, steps, value) as (select id, parent, 0, outline from s union all select w.id, s.parent, w.steps + 1, s.outline from w join s on s.id = w.up where w.value is null and w.steps < 10)
select id as style_id, max(value) as outline from w group by id"""
)
def style_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline levels inherited over parents, ten steps up at most; a chain that loops ends without a level."""
    c = table(spark, sf_dir, "customer")
    parent = F.when(F.col("c_custkey") % 50 == 7, F.col("c_custkey") + 3).otherwise(F.col("c_custkey") - 1)
    styles = c.select(F.col("c_custkey").alias("style_id"), parent.alias("parent"), F.when(F.col("c_custkey") % 17 == 0, (F.col("c_nationkey") % 9).cast("int")).alias("outline"))
    return lookup.inherited(styles, "style_id", "parent", "outline")


@query(
    """select event_id, first_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as next_signup from events"""
)
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next signup of each event's user, itself included."""
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return lookup.next_value(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], signup, "next_signup").select("event_id", "next_signup")


@query(
    """with h as (select conv_id, turn, case when role = 'user' then 0 else 1 + turn % 3 end as level from conversations),
m as (select conv_id, max(turn) + 1 as size from h group by conv_id)
select h.conv_id, h.turn, cast(h.level as bigint) as level, coalesce(min(n.turn), max(m.size)) as section_end
from h join m using (conv_id) left join h n on n.conv_id = h.conv_id and n.turn > h.turn and n.level <= h.level group by h.conv_id, h.turn, h.level"""
)
def section_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the section that a turn heads ends."""
    c = table(spark, sf_dir, "conversations")
    h = c.select("conv_id", "turn", F.when(F.col("role") == "user", F.lit(0)).otherwise(1 + F.col("turn") % 3).cast("bigint").alias("level"))
    sizes = h.groupBy("conv_id").agg((F.max("turn") + 1).alias("size"))
    return lookup.section_ends(h, "conv_id", "turn", "level", sizes).withColumnRenamed("end", "section_end")


@query("select s.free from (select min(k) as free from (select distinct turn + 1 as k from conversations union select 1) x where k not in (select turn from conversations where turn is not null)) s")
def smallest_unused_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.smallest_unused(table(spark, sf_dir, "conversations"), "turn")


@query("select doc_id, cast(length(text) - length(replace(text, '.', '')) as bigint) as n_dots, cast((length(text) - length(replace(text, '|', ''))) as bigint) as n_pipes, contains(text, '(c)') or contains(text, '$') as marked from documents")
def literal_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals with signs that patterns reserve, escaped for patterns."""
    count = lambda s: F.regexp_count("text", F.lit(ft.quoted(s))).cast("bigint")
    marked = F.col("text").rlike(f"{ft.quoted('(c)')}|{ft.quoted('$')}")
    return table(spark, sf_dir, "documents").select("doc_id", count(".").alias("n_dots"), count("|").alias("n_pipes"), marked.alias("marked"))
