"""Ordered, all-or-nothing batches of edits on a relation of blocks, and their log of revisions.

Blocks: doc_id, block_ix, kind, level, text, and, where documents have more than lines, any of WIDE: properties, runs, tables, pictures and section
marks. A batch is the same for all documents and is applied op by op, each to what the one before left. An op that doesn't find exactly what it
names refuses, and a document with a refusal keeps its input whole.

One shuffle gathers each document's blocks in order; ``folio.operators.batch`` runs the whole batch over them, document by document, in
a stream of Arrow batches. So a plan doesn't grow with the ops, and memory follows the longest document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folio.functions import text as ft
from folio.operators import batch
from folio.operators.batch import Refused

__all__ = ["KEYS", "WIDE", "Op", "Refused", "apply", "edited", "from_flags", "minimal", "read_ops", "recorded", "revisions", "split_runs"]

KEYS = ["doc_id", "block_ix", "kind", "level", "text"]
#: What blocks may have besides.
WIDE = {
    "props": "map<string,string>",
    "runs": "array<struct<text:string,props:map<string,string>,author:string,field:boolean>>",
    "widths": "array<bigint>",
    "rows": "array<array<struct<text:string,span:int,merge:string,props:map<string,string>>>>",
    "image": "struct<name:string,width:bigint,height:bigint>",
    "section": "boolean",
}
#: What a row of an edited relation is: a block, the refusal of a document, or a revision.
BLOCK, REFUSAL, REVISION = "block", "refusal", "revision"
#: Rows that are handed on at once.
ROWS = 4096


@dataclass(frozen=True)
class Op:
    """An edit. Whole numbers name blocks by index, negative ones from the end; other text names the only block that holds it."""

    op: str
    args: dict = field(default_factory=dict)

    def checked(self) -> Op:
        batch.checked(self.op, self.args)
        return self


def read_ops(text: str) -> list[Op]:
    """Ops of a JSON list of objects, which may begin with a byte order mark; an object without ``op`` replaces."""
    try:
        found = json.loads(text.removeprefix("\ufeff"))
    except ValueError as e:
        raise Refused(f"ops: {e}") from e
    if not isinstance(found, list) or not all(isinstance(o, dict) for o in found):
        raise Refused("ops must be a list of objects")
    return [Op(o.get("op", "replace"), {k: v for k, v in o.items() if k != "op"}).checked() for o in found]


def from_flags(replace=(), set_text=(), insert_after=(), delete=(), delete_section=(), page_break_before=(), del_row=(), cell=(), add_row=(), like=None) -> list[Op]:
    """Ops of the flags of a command line, in the order of the parameters. Rows are deleted from the last up, so that their numbers mean the
    table as it was; a cell's text may spell line ends as a backslash and n; a new row's values stand between pipes."""
    ops = [Op("replace", {"find": a, "replace": b}) for a, b in replace]
    ops += [Op("set_text", {"block": b, "text": t}) for b, t in set_text]
    ops += [Op("insert", {"after": b, "text": t} | ({"like": like} if like else {})) for b, t in insert_after]
    ops += [Op("delete", {"block": b}) for b in delete]
    ops += [Op("delete_section", {"heading": h}) for h in delete_section]
    ops += [Op("page_break_before", {"block": b}) for b in page_break_before]
    ops += [Op("del_row", {"table": t, "row": int(r)}) for t, r in sorted(del_row, key=lambda x: -int(x[1]))]
    ops += [Op("cell", {"table": t, "row": int(r), "col": int(c), "text": x.replace("\\n", "\n")}) for t, r, c, x in cell]
    ops += [Op("add_row", {"table": t, "after": int(r), "values": v.split("|")}) for t, r, v in add_row]
    return [op.checked() for op in ops]


def _read(row: dict) -> batch.Block:
    runs, rows = row.get("runs"), row.get("rows")
    return batch.Block(
        row["kind"], row["level"], row["text"] or "", dict(row.get("props") or ()),
        None if runs is None else [batch.Run(r["text"] or "", dict(r["props"] or ()), r["author"], bool(r["field"])) for r in runs],
        None if rows is None else list(row.get("widths") or [1] * sum(c["span"] or 1 for c in rows[0])),
        None if rows is None else [[batch.Cell(c["text"] or "", c["span"] or 1, c["merge"], dict(c["props"] or ())) for c in r] for r in rows],
        row.get("image"), bool(row.get("section")),
    )


def _written(b: batch.Block, wide: bool) -> dict:
    if not wide:
        # Without a column for properties a page break shows as the block's kind.
        return {"kind": "break" if "page_break_before" in b.props else b.kind, "level": b.level, "text": b.text}
    runs = None if b.runs is None else [{"text": r.text, "props": list(r.props.items()), "author": r.author, "field": r.field} for r in b.runs]
    rows = None if b.rows is None else [[{"text": c.text, "span": c.span, "merge": c.merge, "props": list(c.props.items())} for c in r] for r in b.rows]
    return {"kind": b.kind, "level": b.level, "text": b.text, "props": list(b.props.items()), "runs": runs, "widths": b.widths, "rows": rows, "image": b.image, "section": b.section}


def edited(blocks: DataFrame, ops: list[Op], author: str | None = None, styles: dict[str, str] | None = None, media: dict[str, tuple] | None = None) -> DataFrame:
    """One relation of all that a batch gives: blocks after it, documents' refusals (op_ix, message), and with ``author`` revisions (op_ix, change,
    removed, added); ``what`` tells them apart.

    ``styles``: names by id; ``media``: (pixels wide, pixels high, dots an inch) by file. Blocks without a document id are one document. A batch
    without ops gives its input, an empty relation an empty one. Malformed ops refuse before anything runs.
    """
    program = [(op.checked().op, op.args) for op in ops]
    columns = [*KEYS, *(c for c in WIDE if c in blocks.columns)]
    wide = len(columns) > len(KEYS)
    own = blocks.select(*KEYS, *[F.col(c).cast(WIDE[c]).alias(c) for c in columns[len(KEYS) :]])
    fields = [T.StructField("what", T.StringType()), T.StructField("op_ix", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("message", "change", "removed", "added")]]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in own.schema.fields), *fields])

    def one(doc: object, rows: list[dict]) -> Iterator[dict]:
        state = batch.Document([_read(r) for r in rows], author, styles, media)
        try:
            state.run(program)
        except Refused as e:
            yield from ({**r, "what": BLOCK} for r in rows)
            yield {"doc_id": doc, "what": REFUSAL, "op_ix": state.now, "message": str(e)}
            return
        for i, b in enumerate(state.blocks):
            row = _written(b, wide)
            yield {"doc_id": doc, "block_ix": i, "what": BLOCK, **{k: v for k, v in row.items() if k in columns}}
        yield from ({"doc_id": doc, "block_ix": i, "what": REVISION, "op_ix": k, "change": c, "removed": r, "added": a} for i, (k, c, r, a) in enumerate(state.revisions))

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents() -> Iterator[tuple[object, list[dict]]]:
            held: list[dict] = []
            for b in batches:
                for row in b.to_pylist():
                    if held and held[0]["doc_id"] != row["doc_id"]:
                        yield held[0]["doc_id"], held
                        held = []
                    held.append(row)
            if held:
                yield held[0]["doc_id"], held

        ready: list[dict] = []
        for doc, rows in documents():
            ready += one(doc, rows)
            if len(ready) >= ROWS:
                yield pa.RecordBatch.from_pylist(ready, out)
                ready = []
        if ready:
            yield pa.RecordBatch.from_pylist(ready, out)

    return own.repartition("doc_id").sortWithinPartitions("doc_id", "block_ix").mapInArrow(run, schema)


def apply(blocks: DataFrame, ops: list[Op], **context: object) -> tuple[DataFrame, DataFrame]:
    """(blocks after the batch, doc_id and the first op that refused). A document with a refusal comes out as it went in."""
    done = edited(blocks, ops, **context)
    columns = [c for c in (*KEYS, *WIDE) if c in done.columns]
    return done.where(F.col("what") == BLOCK).select(*columns), done.where(F.col("what") == REFUSAL).select("doc_id", "op_ix")


def minimal(old: Column, new: Column) -> Column:
    """What a replacement changes: common prefix and suffix, and the middle of either side."""
    prefix = ft.common_prefix(old, new)
    suffix = ft.common_suffix(old, new, prefix)
    middle = lambda c: F.substring(c, (prefix + 1).cast("int"), F.greatest(F.length(c) - prefix - suffix, F.lit(0)).cast("int"))
    return F.struct(prefix.alias("prefix"), suffix.alias("suffix"), middle(old).alias("removed"), middle(new).alias("added"))


def recorded(blocks: DataFrame, ops: list[Op], author: str, stamp: str, **context: object) -> DataFrame:
    """doc_id, rev_ix, op_ix, change (insert, delete, replace or format), removed, added, author, ts: what a batch did, op by op. An insert is
    one revision, however many blocks come after it."""
    done = edited(blocks, ops, author=author, **context).where(F.col("what") == REVISION)
    return done.select("doc_id", F.col("block_ix").alias("rev_ix"), "op_ix", "change", "removed", "added", F.lit(author).alias("author"), F.to_timestamp(F.lit(stamp)).alias("ts"))


def revisions(before: DataFrame, after: DataFrame, author: str, stamp: str) -> DataFrame:
    """doc_id, block_ix, kind (insert, delete or replace), removed, added, author, ts: what differs block by block, for edits that keep blocks
    in their places; ``recorded`` follows those that don't."""
    b = before.select("doc_id", "block_ix", F.col("text").alias("old"))
    a = after.select("doc_id", "block_ix", F.col("text").alias("new"))
    joined = b.join(a, ["doc_id", "block_ix"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    change = minimal(F.coalesce("old", F.lit("")), F.coalesce("new", F.lit("")))
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("replace")
    return joined.withColumn("_c", change).select("doc_id", "block_ix", kind.alias("kind"), F.col("_c.removed").alias("removed"), F.col("_c.added").alias("added"), F.lit(author).alias("author"), F.to_timestamp(F.lit(stamp)).alias("ts"))


def split_runs(runs: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Runs (start, end, text) cut at the edges of matches (m0, m1): by, run_ix, start, end, text, matched.

    Each run gives its pieces in order; a piece lies in a match or outside all.
    """
    edges = runs.join(spans, by, "left").groupBy(*by, "run_ix", "start", "end", "text").agg(F.array_sort(F.collect_list(F.struct("m0", "m1"))).alias("ms"))
    inside = F.filter("ms", lambda m: (m["m0"] < F.col("end")) & (m["m1"] > F.col("start")))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("start", "end"), F.flatten(F.transform(inside, lambda m: F.array(F.greatest(m["m0"], F.col("start")), F.least(m["m1"], F.col("end"))))))))
    cut = edges.withColumn("_c", cuts).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_c") - 1)))
    a, z = F.element_at("_c", F.col("_i")), F.element_at("_c", F.col("_i") + 1)
    piece = F.substring(F.col("text"), (a - F.col("start") + 1).cast("int"), (z - a).cast("int"))
    return cut.select(*by, "run_ix", a.alias("start"), z.alias("end"), piece.alias("text"), F.exists("ms", lambda m: (m["m0"] <= a) & (m["m1"] >= z)).alias("matched"))
