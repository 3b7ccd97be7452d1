"""What a page's content stream paints, and where the things that it names are kept.

Ops: doc_id, page, seq, op, args (numbers), text. A stream is a sequential program over a stack of graphics states, which no built-in expression runs, so each
page's ops are gathered in order and interpreted in Arrow batches: one shuffle by page, memory by the longest page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
SCHEMA = "doc_id long, page long, seq long, text string, x double, y double, size double, fill string, depth int"


@dataclass(frozen=True)
class State:
    matrix: tuple = IDENTITY
    fill: str = "000000"
    size: float = 0.0
    leading: float = 0.0


def product(m: tuple, n: tuple) -> tuple:
    """First m, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o)


def _hex(*levels: float) -> str:
    return "".join(f"{round(255 * min(max(v, 0.0), 1.0)):02X}" for v in levels)


def painted(ops: list[tuple[int, str, list[float], str | None]]) -> Iterator[tuple]:
    """(seq, text, x, y, size, fill, depth) of each text that a page shows. A restore without a save, and ops with too few numbers, change nothing; other
    ops are passed over."""
    state, stack = State(), []
    line = text = IDENTITY
    for seq, op, args, shown in ops:
        n = [float(v) for v in args or ()]
        if op == "q":
            stack.append(state)
        elif op == "Q":
            state = stack.pop() if stack else state
        elif op == "cm" and len(n) == 6:
            state = replace(state, matrix=product(tuple(n), state.matrix))
        elif op == "BT":
            line = text = IDENTITY
        elif op == "Tf" and n:
            state = replace(state, size=n[-1])
        elif op == "TL" and n:
            state = replace(state, leading=n[0])
        elif op in ("Td", "TD") and len(n) == 2:
            state = replace(state, leading=-n[1]) if op == "TD" else state
            line = text = product((1, 0, 0, 1, *n), line)
        elif op == "Tm" and len(n) == 6:
            line = text = tuple(n)
        elif op == "T*":
            line = text = product((1, 0, 0, 1, 0, -state.leading), line)
        elif op == "g" and n:
            state = replace(state, fill=_hex(*[n[0]] * 3))
        elif op == "rg" and len(n) == 3:
            state = replace(state, fill=_hex(*n))
        elif op in ("Tj", "'"):
            if op == "'":
                line = text = product((1, 0, 0, 1, 0, -state.leading), line)
            a, b, c, d, e, f = product(text, state.matrix)
            yield seq, shown or "", e, f, state.size * abs(a * d - b * c) ** 0.5, state.fill, len(stack)


def texts(ops: DataFrame) -> DataFrame:
    """doc_id, page, seq, text, x, y, size, fill, depth (saved states) of every text that pages show, after all matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pages() -> Iterator[tuple]:
            key, held = None, []
            for b in batches:
                for r in b.to_pylist():
                    if held and (r["doc_id"], r["page"]) != key:
                        yield key, held
                        held = []
                    key = (r["doc_id"], r["page"])
                    held.append((r["seq"], r["op"], r["args"], r["text"]))
            if held:
                yield key, held

        names = ["doc_id", "page", "seq", "text", "x", "y", "size", "fill", "depth"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.int32()]
        for key, held in pages():
            rows = [(*key, *p) for p in painted(held)]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    keyed = ops.select(*[F.col(c).cast("long").alias(c) for c in ("doc_id", "page", "seq")], "op", F.col("args").cast("array<double>").alias("args"), "text")
    return keyed.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "seq").mapInArrow(run, SCHEMA)


def resolved(named: DataFrame, objects: DataFrame, by: list[str]) -> DataFrame:
    """``named`` (by, name, value, ref) with ``value`` as it stands there or, where ``ref`` is set, as the object of that number has it; null for a reference
    to nothing."""
    known = objects.select(*by, F.col("object").alias("ref"), F.col("value").alias("_far"))
    joined = named.join(known, [*by, "ref"], "left")
    return joined.select(*by, "name", F.when(F.col("ref").isNull(), F.col("value")).otherwise(F.col("_far")).alias("value"))


def first_existing(candidates: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """by, path: of each group's candidates (by, place, path) the first in order that there is."""
    there = candidates.join(files.select("path").distinct(), "path", "left_semi")
    return there.groupBy(*by).agg(F.min(F.struct("place", "path")).alias("_m")).select(*by, F.col("_m.path").alias("path"))
