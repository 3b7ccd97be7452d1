"""Selectors that must match as many records as stated."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import text as ft

#: Selectors of a batch that every block is held against at once, and characters of them.
MOST_TERMS, MOST_CHARS = 20_000, 16_000_000


def containing(blocks: DataFrame, terms: DataFrame, text: str = "text", term: str = "term") -> DataFrame:
    """Each (term, block) with the term somewhere in the block's text.

    ``terms`` is a stated batch of selectors that all blocks are held against: an automaton of all their strings reads each text once, whatever
    the number of terms. Up to MOST_TERMS strings of MOST_CHARS characters make one automaton; a larger batch is dealt into slices of about that
    size, each of which passes over the blocks. Null and empty terms and texts match nothing; terms that repeat each match.
    """
    real = terms.where(F.length(term) > 0)
    size = real.select(F.countDistinct(term).alias("n"), F.coalesce(F.sum(F.length(term)), F.lit(0)).alias("c")).first()
    slices = max(1, -(-size["n"] // MOST_TERMS), -(-size["c"] // MOST_CHARS))
    dealt = [real.where(F.pmod(F.xxhash64(term), F.lit(slices)) == k) for k in range(slices)]
    return functools.reduce(DataFrame.unionAll, [_found(blocks, t, text, term) for t in dealt])


def _found(blocks: DataFrame, terms: DataFrame, text: str, term: str) -> DataFrame:
    """The hits of one slice of terms, whose size is bounded, so its strings and rows may go to all executors."""
    strings = [r[0] for r in terms.select(term).distinct().collect()]
    at = blocks.columns.index(text)
    shared = blocks.sparkSession.sparkContext.broadcast(strings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for s in shared.value:
            automaton.add_word(s, s)
        automaton.make_automaton()
        for b in batches:
            found = [(i, s) for i, t in enumerate(b.column(at).to_pylist()) if t for s in sorted({s for _, s in automaton.iter(t)})] if shared.value else []
            if found:
                rows = b.take(pa.array([i for i, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([s for _, s in found], pa.string())], names=[*b.schema.names, "_hit"])

    hits = blocks.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in blocks.schema.fields), T.StructField("_hit", T.StringType())]))
    return hits.join(F.broadcast(terms), F.col("_hit") == F.col(term)).drop("_hit")


def expected(matches: DataFrame, selectors: DataFrame, key: str, want: Column | None = None) -> DataFrame:
    """key, n, ok: how many records each selector matched, and whether that is what it wants (one, unless said otherwise)."""
    counted = matches.groupBy(key).agg(F.count("*").alias("n"))
    joined = selectors.join(counted, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("ok", F.col("n") == (F.lit(1) if want is None else want))


def only_one(matches: DataFrame, key: str) -> DataFrame:
    """The matches of those selectors that matched exactly one record."""
    return matches.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")


def first_matches(matches: DataFrame, key: str, order: list[str], most: int = 5) -> DataFrame:
    """The first few matches of each selector, for a refusal's message."""
    return matches.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def strict_index(value: Column) -> Column:
    """A whole number written as such; anything else is null."""
    return F.when(value.rlike("^-?[0-9]+$"), value.try_cast("bigint"))


def from_end(index: Column, size: Column) -> Column:
    """The index, negative ones counting from the end; null outside."""
    at = F.when(index < 0, index + size).otherwise(index)
    return F.when((at >= 0) & (at < size), at)


def in_ranges(blocks: DataFrame, ranges: DataFrame, key: str, index: str = "block_ix") -> DataFrame:
    """Blocks between ``first`` and ``last`` (inclusive) of their document's ranges."""
    return blocks.join(ranges, key).where(F.col(index).between(F.col("first"), F.col("last")))


def counted(docs: DataFrame, find: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n: occurrences of a literal in each document that has any."""
    return docs.select(F.col(key), ft.literal_count(F.col(text), find).alias("n")).where("n > 0")
