"""Before against after: bags of words, lost text, sequence differences, near strings and preserved links."""

from __future__ import annotations

import difflib
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words up to which the sequence difference is exact, and cutoffs for near strings.
EXACT_WORDS = 5000
NEAR = 0.3
#: Candidates that every text is held against at once, and characters of them.
MOST_CANDIDATES, MOST_CHARS = 20_000, 16_000_000


def bag(words: DataFrame, by: list[str], word: str = "word") -> DataFrame:
    return words.groupBy(*by, word).agg(F.count("*").alias("n"))


def bag_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """What one bag has more often than the other: the columns of both (last is the count n), and side, - for lost, + for gained."""
    keys = [c for c in before.columns if c != "n"]
    joined = before.withColumnRenamed("n", "_b").join(after.withColumnRenamed("n", "_a"), keys, "full")
    off = F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))
    return joined.withColumn("_d", off).where("_d <> 0").select(*keys, F.abs("_d").alias("n"), F.when(F.col("_d") > 0, "+").otherwise("-").alias("side"))


def lost(before: DataFrame, after: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """Words that ``after`` has less often, but for those in ``exempt`` (word)."""
    out = bag_difference(before, after).where("side = '-'").drop("side")
    return out if exempt is None else out.join(exempt, "word", "left_anti")


def opcodes(pairs: DataFrame) -> DataFrame:
    """key, op, old0, old1, new0, new1 of rows key, old, new (arrays of words): the differences but for equal stretches.

    The block-matching sequence comparison has no built-in form, so it runs in Arrow batches. Beyond EXACT_WORDS popular words are
    no longer looked at, as the heuristic has it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, old, new in zip(pdf["key"], pdf["old"], pdf["new"], strict=True):
                old, new = list(old) if old is not None else [], list(new) if new is not None else []
                matcher = difflib.SequenceMatcher(None, old, new, autojunk=max(len(old), len(new)) > EXACT_WORDS)
                rows += [(key, *code) for code in matcher.get_opcodes() if code[0] != "equal"]
            yield pd.DataFrame(rows, columns=["key", "op", "old0", "old1", "new0", "new1"])

    return pairs.select("key", "old", "new").mapInPandas(run, "key long, op string, old0 int, old1 int, new0 int, new1 int")


def nearest(wanted: DataFrame, candidates: DataFrame, most: int = 3, cutoff: float = NEAR) -> DataFrame:
    """key, rank, candidate of rows key, text: the most similar of all rows of ``candidates`` (candidate), by matching blocks.

    Candidates are a stated set: up to MOST_CANDIDATES strings of MOST_CHARS characters go to all executors at once; more are dealt into slices of about
    that size, each held against every text, and the best over all slices stay. Equal scores go by the larger string, as the library has it.
    """
    context = wanted.sparkSession.sparkContext
    named = candidates.select("candidate").where("candidate is not null")
    size = named.select(F.count("*").alias("n"), F.coalesce(F.sum(F.length("candidate")), F.lit(0)).alias("c")).first()
    slices = max(1, -(-size["n"] // MOST_CANDIDATES), -(-size["c"] // MOST_CHARS))
    # Rows that repeat are scored once. Comparisons cost far more than rows, so rows are dealt evenly.
    asked = wanted.groupBy(F.col("key").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    asked = asked.repartition(4 * context.defaultParallelism)

    def against(part: DataFrame) -> DataFrame:
        shared = context.broadcast([r[0] for r in part.collect()])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = difflib.SequenceMatcher()
            for pdf in frames:
                rows = []
                for key, text, copies in zip(pdf["key"], pdf["text"], pdf["copies"], strict=True):
                    for c in difflib.get_close_matches(text, shared.value, most, cutoff):
                        matcher.set_seqs(c, text)
                        rows.append((key, text, copies, c, matcher.ratio()))
                yield pd.DataFrame(rows, columns=["key", "text", "copies", "candidate", "score"])

        return asked.mapInPandas(run, "key long, text string, copies long, candidate string, score double")

    dealt = [named] if slices <= 1 else [named.where(F.pmod(F.xxhash64("candidate"), F.lit(slices)) == k) for k in range(slices)]
    scored = functools.reduce(DataFrame.unionAll, map(against, dealt))
    place = F.row_number().over(Window.partitionBy("key", "text").orderBy(F.desc("score"), F.desc("candidate")))
    best = scored.withColumn("rank", place).where(F.col("rank") <= most)
    return best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("key", "rank", "candidate")


def missing(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that ``after`` lacks."""
    return before.select(*keys).distinct().join(after.select(*keys).distinct(), keys, "left_anti")
