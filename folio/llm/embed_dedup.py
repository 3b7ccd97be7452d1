"""Near-duplicate embeddings: sign hashing by random hyperplanes in several tables, exact cosines, components.

Equal vectors are folded into one representative with a weight first, so a hot vector costs one row. Each representative gets a code of ``bits``
signs in each of ``tables`` tables. Bits follow the number of vectors (buckets hold about BUCKET of them), and tables
follow from the bits so that a pair exactly at the threshold is missed with a probability of MISS at most; closer pairs are missed far
less often.

Only ids and codes are dealt to the tables' buckets. There all signs together estimate the angle; a pair more than SIGMAS deviations beyond the
threshold's angle can't link. Vectors that have a partner left are fetched into their bucket, and cosines are computed in double precision.
Both are done by blocks of BLOCK vectors; a bucket of any size is dealt out as pairs of blocks. A pair that meets in several tables counts in
the first. Blocks return counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.blockwise import by_group, forest, group_starts
from folio.llm.common import checkpoint, tidy
from folio.llm.components import components

THRESHOLD = 0.9
BUCKET, BLOCK, MISS = 256, 512, 1e-4
#: Deviations of the share of unequal signs, and comparisons of codes at once.
SIGMAS, AT_ONCE = 5, 1 << 22
SEED = 20240601


def shape_of(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = max(1, math.ceil(math.log2(max(2.0, n / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - meet)))


def unit_vectors(values: list) -> tuple[list[int], list[np.ndarray]]:
    """Positions and unit vectors of those that can link: not null, not zero, all components there and finite."""
    keep, out = [], []
    for i, v in enumerate(values):
        if v is None or len(v) == 0 or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if not np.isfinite(x).all():
            continue
        top = np.abs(x).max()
        if top == 0:
            continue
        x = x / top
        out.append(x / np.sqrt((x * x).sum()))
        keep.append(i)
    return keep, out


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, bits]).standard_normal((tables * bits, dim))


def _codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (x @ _planes(x.shape[1], bits, tables).T > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _code_type(bits: int) -> str:
    return "<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4"


def signs_apart(threshold: float, signs: int) -> float:
    """How many of so many signs two vectors at the threshold may differ in, SIGMAS deviations allowed."""
    share = math.acos(threshold) / math.pi
    return signs * share + SIGMAS * math.sqrt(signs * share * (1 - share))


def _first_here(codes: np.ndarray, x: np.ndarray, y: np.ndarray, table: int) -> np.ndarray:
    """Which of the pairs (x, y), all in one bucket of ``table``, don't meet in an earlier table."""
    out = np.ones(len(x), bool)
    step = max(1, AT_ONCE // max(1, table))
    for a in range(0, len(x) if table else 0, step):
        out[a : a + step] = ~(codes[x[a : a + step], :table] == codes[y[a : a + step], :table]).any(axis=1)
    return out


def _block_pairs(close: np.ndarray, part: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a block or a pair of blocks that are marked in ``close``."""
    close = np.triu(close, 1)
    if lo != hi:
        close &= part[:, None] != part[None, :]
    return np.nonzero(close)


def links(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept: a row for each row of ``vectors``.

    Pairs with cosine >= threshold link. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and
    so do vectors of different lengths. Equal vectors link with each other. An empty table gives an empty one. Rows that repeat an id are separate
    vectors in the counts and one node in the components; rows without an id link with nothing and are kept. Of a component the smallest id stays.
    Other columns are ignored, whatever their names.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, units = unit_vectors(b.column(1).to_pylist())
            key, packed = [None] * b.num_rows, [None] * b.num_rows
            for i, x in zip(keep, units, strict=True):
                raw = (x + 0.0).tobytes()
                key[i], packed[i] = hashlib.blake2b(raw, digest_size=16).digest(), raw
            yield pa.record_batch([b.column(0), pa.array(key, pa.binary()), pa.array(packed, pa.binary())], names=["vec_id", "key", "x"])

    keyed = checkpoint(rows.mapInArrow(tidy(fold), "vec_id long, key binary, x binary"))
    folded = keyed.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("x").alias("x"))
    # One node for each vector; its number stands for it from here on.
    reps = checkpoint(folded.withColumn("id", F.monotonically_increasing_id()))
    n = reps.count()
    bits, tables = shape_of(n, threshold)
    kind, apart = _code_type(bits), signs_apart(threshold, bits * tables)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            xs = [np.frombuffer(x.as_py()) for x in b.column(1)]
            ids = np.asarray(b.column(0))
            for dim in sorted({len(x) for x in xs}):
                at = np.array([i for i, x in enumerate(xs) if len(x) == dim])
                for part in np.array_split(at, max(1, len(at) // 512)):
                    codes = _codes(np.stack([xs[i] for i in part]), bits, tables)
                    yield pa.record_batch([pa.array(ids[part]), pa.array(np.full(len(part), dim)), pa.array([c.astype(kind).tobytes() for c in codes], pa.binary())], names=["id", "dim", "codes"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), kind).reshape(-1, tables).astype(np.int64)
                for t in range(tables):
                    yield pa.record_batch([pa.array(np.full(len(codes), t, np.int32)), pa.array((codes[:, t] << 31) + np.asarray(part.column(1))), part.column(0), part.column(2)], names=["t", "code", "id", "codes"])

    coded = checkpoint(reps.select("id", "x").mapInArrow(tidy(code), "id long, dim long, codes binary"))
    dealt = coded.mapInArrow(tidy(deal), "t int, code long, id long, codes binary")
    sizes = dealt.groupBy("t", "code").count().where("count > 1")
    sizes = checkpoint(sizes.select("t", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")))
    # A member of part p meets its own and all later parts as the left side, all earlier ones as the right side.
    placed = dealt.join(sizes, ["t", "code"]).withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("t", "code", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "p", "id", "codes")

    def sketched(group: pa.Table) -> pa.RecordBatch:
        """Members of blocks that have a partner there whose signs allow a link and whom they don't meet earlier."""
        t, code_, lo, hi, part, ids = (group.column(i).to_numpy() for i in range(6))
        codes = np.frombuffer(b"".join(group.column(6).to_pylist()), kind).reshape(-1, tables)
        starts = group_starts(t, code_, lo, hi)
        some = np.zeros(len(ids), bool)
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
            own = codes[a:z]
            signs = ((own[:, :, None] >> np.arange(bits, dtype=own.dtype)) & 1).reshape(z - a, -1).astype(np.float32) * 2 - 1
            x, y = _block_pairs((bits * tables - signs @ signs.T) / 2 <= apart, part[a:z], lo[a], hi[a])
            ok = _first_here(own, x, y, int(t[a]))
            some[a + x[ok]] = some[a + y[ok]] = True
        keep = pa.array(some)
        return pa.record_batch([group.column(i).combine_chunks().filter(keep) for i in (0, 1, 2, 3, 4, 5, 6)], names=["t", "code", "lo", "hi", "p", "id", "codes"])

    close = by_group(placed, sketched, "t int, code long, lo int, hi int, p int, id long, codes binary", keys=4)
    fetched = checkpoint(close).join(reps.select("id", "weight", "x"), "id").select("t", "code", "lo", "hi", "p", "id", "codes", "weight", "x")

    def compared(group: pa.Table) -> pa.RecordBatch:
        t, code_, lo, hi, part, ids = (group.column(i).to_numpy() for i in range(6))
        weight = group.column(7).to_numpy()
        codes = np.frombuffer(b"".join(group.column(6).to_pylist()), kind).reshape(-1, tables)
        starts = group_starts(t, code_, lo, hi)
        counts = np.zeros(len(ids), np.int64)
        pairs = [np.zeros((2, 0), np.int64)]
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
            v = np.stack([np.frombuffer(v.as_buffer()) for v in group.column(8).slice(a, z - a)])
            x, y = _block_pairs(v @ v.T >= threshold, part[a:z], lo[a], hi[a])
            ok = _first_here(codes[a:z], x, y, int(t[a]))
            x, y = a + x[ok], a + y[ok]
            np.add.at(counts, x, weight[y])
            np.add.at(counts, y, weight[x])
            pairs.append(np.stack([ids[x], ids[y]]))
        edges = forest(np.concatenate(pairs, axis=1))
        at = np.flatnonzero(counts)
        own = pa.array(ids[at], pa.int64())
        return pa.record_batch([pa.concat_arrays([own, edges.column(0)]), pa.concat_arrays([own, edges.column(1)]), pa.array(np.concatenate([counts[at], np.zeros(edges.num_rows, np.int64)]))], names=["a", "b", "n"])

    found = checkpoint(by_group(fetched, compared, "a long, b long, n long", keys=4))
    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    edges = found.where("n = 0").select("a", "b")
    # Vectors that share an id are one node of the components.
    named = keyed.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.xxhash64("key")).alias("lo"), F.max(F.xxhash64("key")).alias("hi"))
    again = checkpoint(named.where("lo <> hi").select("vec_id"))
    some_again = not again.isEmpty()
    if some_again:
        owned = checkpoint(keyed.where("key is not null").join(again, "vec_id", "left_semi").select("vec_id", "key").distinct().join(reps.select("key", "id"), "key").select("vec_id", "id"))
        least = owned.groupBy("vec_id").agg(F.min("id").alias("b"))
        edges = edges.unionAll(owned.join(least, "vec_id").where("id > b").select(F.col("id").alias("a"), "b"))
    by_rep = checkpoint(reps.select("key", "id", "least", "weight").join(counts, "id", "left").join(components(edges), "id", "left").withColumn("component", F.coalesce("component", "id")))
    smallest = by_rep.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = checkpoint(by_rep.join(smallest, "component").select("key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    out = keyed.select("vec_id", "key").join(by_key, "key", "left")
    if some_again:
        by_id = keyed.join(again, "vec_id", "left_semi").join(by_key, "key").groupBy("vec_id").agg(F.min("component_id").alias("own"))
        out = out.join(checkpoint(by_id), "vec_id", "left").withColumn("component_id", F.coalesce("own", "component_id"))
    has_id = F.col("vec_id").isNotNull()
    component = F.when(has_id, F.coalesce("component_id", "vec_id"))
    count = F.when(has_id, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", count.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
