"""Queries on whole batches of edits: reports with tables, runs, guards, revisions and pictures."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import edits
from folio.operators.edits import Op
from folio.plans.registry import query, table

RUN, CELL = "struct<text:string,props:map<string,string>,author:string,field:boolean>", "struct<text:string,span:int,merge:string,props:map<string,string>>"


def _run(text, **props):
    """A run; ``author`` and ``field`` may be columns."""
    author, generated = props.pop("author", F.lit(None)), props.pop("field", F.lit(False))
    own = F.create_map(*[F.lit(x) for kv in props.items() for x in kv]) if props else F.create_map().cast("map<string,string>")
    return F.struct((text if not isinstance(text, str) else F.lit(text)).alias("text"), own.cast("map<string,string>").alias("props"), author.cast("string").alias("author"), generated.alias("field"))


def _row(*texts):
    return F.array(*[F.struct((t if not isinstance(t, str) else F.lit(t)).alias("text"), F.lit(1).alias("span"), F.lit(None).cast("string").alias("merge"), F.create_map().cast("map<string,string>").alias("props")) for t in texts])


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a report: title, a paragraph of three runs, a table of its turns, a part for each turn, and an end."""
    c = table(spark, sf_dir, "conversations")
    ident = F.col("conv_id").alias("doc_id")
    none = [F.lit(None).cast(f"array<{RUN}>").alias("runs"), F.lit(None).cast(f"array<array<{CELL}>>").alias("rows")]
    block = lambda df, o, kind, level, text, *extra: df.select("doc_id", F.lit(o[0]).alias("o") if isinstance(o, tuple) else o.alias("o"), F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"), text.alias("text"), *(extra or none))
    docs = c.select(ident).distinct()
    turns = c.select(ident, "turn", "role", "text")
    cells = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").cast("string").alias("n")))), lambda x: _row(x["turn"].cast("string"), x["role"], x["n"], "done"))
    tables = turns.groupBy("doc_id").agg(F.concat(F.array(_row("Identifier", "Role", "Amount", "State")), cells).alias("rows"))
    runs = F.array(_run("Term of "), _run("payment", bold="true"), _run(" is 30 days."))
    parts = [
        block(docs, (0,), "heading", 0, F.concat(F.lit("Report on "), F.col("doc_id").cast("string"))),
        block(docs, (1,), "paragraph", None, F.lit(""), runs.cast(f"array<{RUN}>").alias("runs"), none[1]),
        block(tables, (2,), "table", None, F.lit(""), none[0], F.col("rows").cast(f"array<array<{CELL}>>")),
        block(turns, (F.col("turn") * 2 + 3), "heading", 1, F.concat(F.lit("Part "), F.col("turn").cast("string"), F.lit("."))),
        block(turns, (F.col("turn") * 2 + 4), "paragraph", None, F.col("text")),
        block(docs, (1_000_000,), "heading", 0, F.lit("Final note.")),
    ]
    every = functools.reduce(DataFrame.unionByName, [p.withColumn("o", F.col("o").cast("bigint")) for p in parts])
    # Numbered by place, not densely: a document's blocks need an order only.
    return every.select("doc_id", F.col("o").cast("int").alias("block_ix"), "kind", "level", "text", "runs", "rows", F.when(F.col("rows").isNotNull(), F.array(*[F.lit(w).cast("bigint") for w in (1000, 4000, 2000, 2000)])).alias("widths"))


STRESS = [
    Op("replace", {"find": "Report on", "replace": "Survey on"}),
    Op("replace", {"find": "payment is 30 days", "replace": "payment is 45 days"}),
    Op("cell", {"table": "Identifier", "row": 1, "col": 2, "text": "999"}),
    Op("insert", {"after": "Term of payment", "text": "Additional method."}),
    Op("insert_table", {"after": "Additional method.", "rows": [["Measure", "Value"], ["Checked", "280"]]}),
    Op("set_text", {"block": "Final note.", "text": "Final note: checked."}),
    Op("delete_section", {"heading": "Part 1."}),
    Op("move", {"block": "Additional method.", "after": "Part 0."}),
    *[Op("add_row", {"table": "Identifier", "after": -1, "values": [str(i), f"New row {i}", str(100 + i), "added"]}) for i in range(181, 291)],
    *[Op("del_row", {"table": "Identifier", "row": 1}) for _ in range(10)],
]


@query(
    """with t as (select conv_id, turn, role, length(text) as n, row_number() over (partition by conv_id order by turn) as k from conversations),
r as (select conv_id, k, turn || ' | ' || role || ' | ' || case when k = 1 then '999' else cast(n as varchar) end || ' | done' as line from t
  union all select distinct conv_id, i, i || ' | New row ' || i || ' | ' || (100 + i) || ' | added' from t, unnest(range(181, 291)) u(i)),
g as (select conv_id, string_agg(line, chr(10) order by k) as body from (select *, row_number() over (partition by conv_id order by k) as p from r) x where p > 10 group by conv_id),
b as (select distinct conv_id, 0 as o, 'heading' as kind, 0 as level, 'Survey on ' || conv_id as text from t
  union all select distinct conv_id, 1, 'paragraph', null, 'Term of payment is 45 days.' from t
  union all select distinct conv_id, 2, 'table', null, 'Measure | Value' || chr(10) || 'Checked | 280' from t
  union all select conv_id, 3, 'table', null, 'Identifier | Role | Amount | State' || chr(10) || body from g
  union all select conv_id, 10 + 10 * turn, 'heading', 1, 'Part ' || turn || '.' from t where turn <> 1
  union all select distinct conv_id, 11, 'paragraph', null, 'Additional method.' from t
  union all select conv_id, 12 + 10 * turn, 'paragraph', null, text from conversations where turn <> 1
  union all select distinct conv_id, 1000000, 'heading', 0, 'Final note: checked.' from t)
select conv_id as doc_id, cast(row_number() over (partition by conv_id order by o) - 1 as integer) as block_ix, kind, level, text from b"""
)
def edit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of 128 ops on every report: replacements, a cell, inserts, a table, a section, a move, 110 new rows and 10 old ones gone."""
    return edits.apply(_reports(spark, sf_dir), STRESS)[0].select("doc_id", "block_ix", "kind", "level", "text")


@query(
    """select distinct conv_id as doc_id, cast(k as integer) as run_ix, t as text, b as bold from conversations, (values (0, 'Term of ', null), (1, 'payment', 'true'), (2, ' is ', null), (3, '45 days', null), (4, '.', null)) v(k, t, b)"""
)
def run_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs after a replacement that keeps other words' look and a colour for found text."""
    ops = [Op("replace", {"find": "payment is 30 days", "replace": "payment is 45 days"}), Op("format", {"find": "45 days", "color": "#c00000"})]
    out = edits.apply(_reports(spark, sf_dir).where("block_ix = 1"), ops)[0]
    runs = out.select("doc_id", F.posexplode("runs").alias("run_ix", "r"))
    return runs.where((F.col("run_ix") != 3) | (F.col("r.props")["color"] == "C00000")).select("doc_id", "run_ix", "r.text", F.col("r.props")["bold"].alias("bold"))


TABLES = """with t as (select o_custkey as doc_id, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as integer) as row_ix, count(*) over (partition by o_custkey) as n, o_orderpriority as a, o_orderstatus as s, cast(o_orderkey as varchar) as k from orders)"""


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as one table of three columns."""
    o = table(spark, sf_dir, "orders")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))), lambda x: _row(x["o_orderstatus"], x["o_orderpriority"], x["o_orderkey"].cast("string")))
    t = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(rows.cast(f"array<array<{CELL}>>").alias("rows"))
    return t.select("doc_id", F.lit(0).alias("block_ix"), F.lit("table").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text"), "rows", F.array(*[F.lit(3000).cast("bigint")] * 3).alias("widths"))


@query(
    TABLES
    + """, c as (select doc_id, row_ix, 0 as cell_ix, case when n < 2 then s when row_ix = 0 then a || chr(10) || lead(a) over (partition by doc_id order by row_ix) when row_ix = 1 then '' else a end as text, case when n < 2 then null when row_ix = 0 then 'restart' when row_ix = 1 then 'continue' end as merge, n from t
union all select doc_id, row_ix, 1, case when n < 2 then a else '' end, null, n from t union all select doc_id, row_ix, 2, k, null, n from t)
select doc_id, row_ix, cast(cell_ix as integer) as cell_ix, text, merge, case when n < 2 then '3000,3000,3000' else '3000,1500,4500' end as widths from c"""
)
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new blank column, the first one gone, new widths and two merged cells; tables of one row refuse the merge and stay whole."""
    ops = [Op("add_col", {"table": 0, "after": 1}), Op("del_col", {"table": 0, "col": 0}), Op("col_widths", {"table": 0, "widths": [2, 1, 3]}), Op("merge_cells", {"table": 0, "row": 0, "col": 0, "rows": 2})]
    out = edits.apply(_order_tables(spark, sf_dir), ops)[0]
    rows = out.select("doc_id", F.array_join(F.col("widths").cast("array<string>"), ",").alias("widths"), F.posexplode("rows").alias("row_ix", "row"))
    return rows.select("doc_id", "row_ix", F.posexplode("row").alias("cell_ix", "c"), "widths").select("doc_id", "row_ix", "cell_ix", "c.text", "c.merge", "widths")


@query(
    TABLES
    + """, r as (select doc_id, row_ix, case when n < 4 then s when row_ix = 1 then s || chr(10) || lead(s) over w when row_ix = 2 then '' else s end as text, n, lead(s) over w as below, lag(s) over w as above, s from t window w as (partition by doc_id order by row_ix)),
d as (select doc_id, case when n < 4 then row_ix when row_ix = 2 then 1 when row_ix > 2 then row_ix - 1 else 0 end as row_ix, case when n >= 4 and row_ix = 2 then above || chr(10) || s else text end as text, case when n >= 4 and row_ix = 2 then 'restart' end as merge from r where n < 4 or row_ix <> 1)
select doc_id, cast(row_ix as integer) as row_ix, text, merge from d union all select distinct doc_id, cast(n - 1 as integer), 'new', null from t where n >= 4"""
)
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a vertical merge goes, so the next one takes its beginning and text; a row comes at the end. Short tables refuse."""
    ops = [Op("merge_cells", {"table": 0, "row": 1, "col": 0, "rows": 2}), Op("cell", {"table": 0, "row": 3, "col": 1, "text": "seen"}), Op("del_row", {"table": 0, "row": 1}), Op("add_row", {"table": 0, "values": ["new", "", ""]})]
    out = edits.apply(_order_tables(spark, sf_dir), ops)[0]
    return out.select("doc_id", F.posexplode("rows").alias("row_ix", "row")).select("doc_id", "row_ix", F.col("row")[0]["text"].alias("text"), F.col("row")[0]["merge"].alias("merge"))


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paragraphs of one run: every third is another author's insertion, every fifth generated, every fourth ends a section."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    run = _run(F.col("text"), author=F.when(k % 3 == 0, "other"), field=(k % 5 == 0))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_ix"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), "text", F.array(run).cast(f"array<{RUN}>").alias("runs"), (k % 4 == 0).alias("section"))


@query(
    """with n as (select distinct conv_id as doc_id from conversations)
select doc_id, 'revision' as guard from n where doc_id % 3 = 0 union all select doc_id, 'section' from n where doc_id % 4 in (0, 3)
union all select doc_id, 'generated' from n where doc_id % 5 = 0 union all select doc_id, 'anchor' from n"""
)
def edit_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that refuse an edit of another author's insertion, over a section's end, of generated text, or into the moved range itself."""
    b = _guarded(spark, sf_dir)
    batches = {
        "revision": ([Op("format", {"block": 0, "bold": True})], "desk"),
        "section": ([Op("insert", {"after": -1, "text": "end"}), Op("delete", {"block": 0, "to": 1})], None),
        "generated": ([Op("set_text", {"block": 0, "text": "new"}), Op("replace", {"find": "kept", "replace": "lost"})], None),
        "anchor": ([Op("move", {"block": 0, "to": 0, "after": 0})], None),
    }
    # A generated run stays behind a new text; editing it is refused.
    marked = b.where("block_ix = 0").withColumn("runs", F.concat(F.array(_run("old")).cast(f"array<{RUN}>"), F.array(F.struct(F.lit("kept").alias("text"), F.create_map().cast("map<string,string>").alias("props"), F.lit(None).cast("string").alias("author"), (F.col("doc_id") % 5 == 0).alias("field")))))
    found = [edits.edited(marked if guard == "generated" else b, ops, author=author).where("what = 'refusal'").select("doc_id", F.lit(guard).alias("guard"), "op_ix") for guard, (ops, author) in batches.items()]
    every = functools.reduce(DataFrame.unionByName, found)
    return every.where("guard <> 'generated' or op_ix = 1").where("guard <> 'generated' or doc_id % 5 = 0").select("doc_id", "guard")


@query(
    """with n as (select conv_id, count(*) as n from conversations group by conv_id), f as (select conv_id, text from conversations where turn = 0)
select n.conv_id as doc_id, cast(v.i as integer) as rev_ix, cast(v.o as integer) as op_ix, v.c as change, case when v.i = 2 then f.text else '' end as removed, case v.i when 0 then 'one' when 1 then 'two' when 3 then f.text else '' end as added
from n join f using (conv_id), (values (0, 0, 'insert'), (1, 0, 'insert'), (2, 1, 'delete'), (3, 1, 'insert')) v(i, o, c)"""
)
def tracked_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch records: two inserted paragraphs, and a move as a deletion and an insertion."""
    ops = [Op("insert", {"before": 0, "texts": ["one", "two"]}), Op("move", {"block": 2, "before": 0})]
    b = _guarded(spark, sf_dir).withColumn("section", F.lit(False))
    return edits.recorded(b, ops, "desk", "2026-01-01 00:00:00").select("doc_id", "rev_ix", "op_ix", "change", "removed", "added")


@query(
    """with p as (select p_partkey as doc_id, cast(p_size * 100000 as double) as w, cast(p_size * 50000 as double) as h from part),
v as (select doc_id, cast(round_even(300 * least(w / 300, h / 200), 0) as bigint) as rw, cast(round_even(200 * least(w / 300, h / 200), 0) as bigint) as rh from p)
select doc_id, 'a.png' as name, cast(1440000 as bigint) as width, cast(720000 as bigint) as height from p union all select doc_id, 'b.png', rw, rh from v union all select doc_id, 'c.png', cast(1800000 as bigint), cast(1200000 as bigint) from p"""
)
def image_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures resized, replaced within their box, and inserted in their natural size."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("bigint") * 50_000
    image = lambda ix, name: p.select(F.col("p_partkey").alias("doc_id"), F.lit(ix).alias("block_ix"), F.lit("image").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text"), F.struct(F.lit(name).alias("name"), (size * 2).alias("width"), size.alias("height")).alias("image"))
    ops = [Op("resize_image", {"image": 0, "width_cm": 4}), Op("replace_image", {"image": 1, "file": "b.png"}), Op("insert_image", {"after": 1, "file": "c.png", "width_cm": 5})]
    out = edits.apply(image(0, "a.png").unionByName(image(1, "a.png")), ops, media={"b.png": (300, 200, 96), "c.png": (300, 200, 96)})[0]
    return out.select("doc_id", "image.name", "image.width", "image.height")
