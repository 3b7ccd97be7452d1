"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target number of words. A document is taken ``target / source size`` times: the whole part is certain, the
fraction is its inclusion probability. The flight phase of the cube method moves the probabilities of three undecided
documents at a time along the null space of the balancing constraints (words and documents), in a random direction that
keeps each one's expectation, until one of them is 0 or 1. Two are left undecided when a block ends.

Blocks of about BLOCK documents of one source fly in parallel; what they leave undecided is dealt into fewer blocks and flies
again, until one block of the source is left, whatever other sources still have. RESERVE documents of each block, of all lengths,
don't fly. In a source's last block they and the two that flight leaves are the landing problem, settled by the outcome nearest to
the expected totals, so the words taken come within a few of the target where a source has enough documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import Spill, checkpoint

#: Shares of sources in order of their names, repeating; the words of the mix as a share of all; how often a document may be taken.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 4096
#: Sources up to which their table, of some 40 bytes a row, is broadcast; beyond that it is joined.
BROADCAST_SOURCES = 100_000
#: Documents of a block that wait for the next flight, or in the last block for the landing, besides the flight's own rest.
RESERVE = 12
EDGE = 1e-9
SEED = 17


def size_of(text: Column) -> Column:
    """Words of a text: runs that aren't ASCII white space. Null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """source, source_size, rank: by code point, null last. Ranges are sorted in parallel; only their sizes go to the driver."""
    ordered = checkpoint(sources.repartitionByRange(F.col("source").isNull(), F.col("source").cast("binary")).sortWithinPartitions(F.col("source").isNull(), F.col("source").cast("binary")).withColumn("_at", F.monotonically_increasing_id()))
    counts = ordered.groupBy(F.shiftright("_at", 33).alias("part")).count().orderBy("part").collect()
    before, total = {}, 0
    for row in counts:
        before[row["part"]] = total
        total += row["count"]
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    return ordered.select("source", "source_size", (F.element_at(offset, F.shiftright("_at", 33)) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of rows source, size.

    Sources take their weights in order of their names, repeating, and share ``share`` times all words by them. A target stops at
    ``most`` times its source's words; what is over is shared again by weight until none is above. Sources without words have target 0.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    now = checkpoint(_ranked(sums).select("source", F.col("source_size").cast("long").alias("source_size"), weight.alias("w"), (F.col("source_size") * most).cast("double").alias("most")))
    left = share * (now.agg(F.sum("source_size")).first()[0] or 0)
    # The level is the words a unit of weight gets; it only rises, and each round more sources are full.
    level, full = 0.0, -1
    while True:
        row = now.agg(F.sum(F.when(F.col("w") * level >= F.col("most"), F.col("most"))).alias("taken"), F.sum(F.when(F.col("w") * level >= F.col("most"), F.lit(0.0)).otherwise(F.col("w"))).alias("open"), F.count(F.when(F.col("w") * level >= F.col("most"), 1)).alias("full")).first()
        if row["full"] == full or not row["open"]:
            break
        full = row["full"]
        level = (left - (row["taken"] or 0.0)) / row["open"]
    return now.select("source", "source_size", F.least(F.col("w") * level, F.col("most")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities through the null space of the word and document totals until at most two are left undecided."""
    p = p.astype(float).copy()
    w = size / max(1.0, float(size.max(initial=1)))
    draws = rng.random(len(p) + 3)
    held: list[int] = []
    for k in range(len(p)):
        if EDGE < p[k] < 1 - EDGE:
            held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        # A vector that changes neither total: u sums to 0 and so does u * w.
        u = (w[b] - w[c], w[c] - w[a], w[a] - w[b])
        if max(map(abs, u)) < 1e-12:
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u, strict=True) if x)
        step = up if draws[k] * (up + down) < down else -down
        for i, x in zip(held, u, strict=True):
            p[i] += step * x
        held = [i for i in held if EDGE < p[i] < 1 - EDGE]
    return np.where(p <= EDGE, 0.0, np.where(p >= 1 - EDGE, 1.0, p))


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles what is undecided, RESERVE + 2 documents at most, by trying all outcomes: nearest in words, a document counting as one."""
    at = np.flatnonzero((p > 0) & (p < 1))
    if not len(at):
        return p
    outcomes = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    off = outcomes - p[at]
    best = int((np.abs(off @ size[at]) + np.abs(off.sum(axis=1))).argmin())
    p = p.copy()
    p[at] = outcomes[best]
    return p


def block_flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight of a block, for which RESERVE documents of all lengths wait on the ground."""
    by_size = np.argsort(size, kind="stable")
    waiting = by_size[np.unique(np.linspace(0, len(size) - 1, RESERVE).astype(int))]
    flying = np.setdiff1d(np.arange(len(size)), waiting)
    p = p.astype(float).copy()
    p[flying] = flight(p[flying], size[flying], rng)
    return p


def last_flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight of a source's last block and the landing."""
    return landing(block_flight(p, size, rng), size)


def _flying(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a block does; a block that is its source's only one lands as well."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size", "p", "t"], kind="stable")
        seed = zlib.crc32(repr((pdf._s.iloc[0], bool(pdf._n.iloc[0]), int(pdf._b.iloc[0]))).encode())
        size = pdf["size"].to_numpy()
        p = (last_flight if pdf["blocks"].iloc[0] == 1 else block_flight)(pdf.p.to_numpy(), size, np.random.default_rng([SEED, level, seed]))
        return pdf.assign(p=p)[["doc_id", "size", "source_size", "target", "source", "copies", "p", "h", "t"]]

    return fly


_ROWS = "doc_id long, size long, source_size long, target double, source string, copies long, p double, h long, t long"


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target (words, of the document's source), taken (words the mix takes, repeats counted), copies, source, t
    (a hash of the text).

    One row for each row of ``docs``, rows that repeat being separate documents. Null and blank texts have size 0 and take 0 words. A null source
    is a source. Reruns agree, whatever the partitions: documents fly in the order of a hash of their ids. Extra columns are ignored; an
    empty table gives an empty one. A source of any size is dealt into blocks; nothing of a source is gathered but its totals.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("t"))
    sized = Spill(rows)
    goal = checkpoint(targets(sized.df, weights, share, most))
    n_sources = goal.count()
    # A null source matches itself by the second key.
    keyed = goal.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), "source_size", "target")
    small = F.broadcast(keyed) if n_sources <= BROADCAST_SOURCES else keyed
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.df.withColumns({"_s": F.coalesce("source", F.lit("")), "_n": F.col("source").isNull()}).join(small, ["_s", "_n"])
    start = joined.withColumn("rate", rate).select("doc_id", "size", "source_size", "target", "source", F.floor(F.col("rate") + EDGE).cast("long").alias("copies"), F.greatest(F.lit(0.0), F.col("rate") - F.floor(F.col("rate") + EDGE)).alias("p"), F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("size")).alias("h"), "t")
    now = Spill(start)
    sized.drop()
    done: list[DataFrame] = [now.df.where(f"p <= {EDGE}")]
    undecided = now.df.where(f"p > {EDGE}")
    spills = [now]
    level = 0
    while True:
        level += 1
        counts = undecided.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        counts = checkpoint(counts.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), "blocks"))
        last = (counts.agg(F.max("blocks")).first()[0] or 1) <= 1
        placed = undecided.withColumns({"_s": F.coalesce("source", F.lit("")), "_n": F.col("source").isNull()}).join(F.broadcast(counts) if n_sources <= BROADCAST_SOURCES else counts, ["_s", "_n"])
        placed = placed.withColumn("_b", F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks")).cast("int"))

        flown = Spill(placed.groupBy("_s", "_n", "_b").applyInPandas(_flying(level), _ROWS))
        spills.append(flown)
        settled = flown.df.where("p <= 0 or p >= 1")
        done.append(settled)
        if last:
            break
        undecided = flown.df.where("p > 0 and p < 1")
    out = done[0].withColumn("p", F.lit(0.0))
    for d in done[1:]:
        out = out.unionAll(d)
    copies = F.col("copies") + F.col("p").cast("long")
    result = checkpoint(out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source", "t"))
    for s in spills:
        s.drop()
    return result


def take(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them; columns as they are, whatever their names.

    Rows are found again by id, source and a hash of the text, so rows without an id spread as well. Only rows equal in all
    three are numbered, and stand for each other. An empty table gives an empty one.
    """
    ident, value, kind = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"), F.col(f"`{source}`")
    keys = ["i", "no_i", "t", "s", "no_s", "k"]
    named = lambda i, t, s: [F.coalesce(i, F.lit(0)).alias("i"), i.isNull().alias("no_i"), t.alias("t"), F.coalesce(s, F.lit("")).alias("s"), s.isNull().alias("no_s")]
    place = F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy("i"))
    left = docs.select(*named(ident, F.xxhash64(value), kind), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("k", place)
    right = mix(docs, doc_id, text, source).select(*named(F.col("doc_id"), F.col("t"), F.col("source")), "copies").withColumn("k", place)
    joined = left.join(right.where("copies > 0"), keys).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return joined.select("row.*")
