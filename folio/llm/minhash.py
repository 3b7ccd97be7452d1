"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming join, links confirmed on full sets.

A document's set holds its distinct shingles of WIDTH words, each named by 128 bits. Documents with equal sets are folded into one
representative. A signature has SYMBOLS symbols of 16 bits; at a Jaccard similarity of 0.75 a symbol differs with probability 1/4, so 16 of 64
are expected to differ and more than RADIUS = 31 do with a probability of about 1e-5.

Multi-index join: the signature is split into CHUNKS chunks. By the pigeonhole principle two signatures that differ in at
most RADIUS symbols differ in at most RADIUS // CHUNKS = 1 symbol of some chunk. Each chunk is therefore looked up with every way of
leaving out one symbol, which finds all pairs within RADIUS, without exception.

Only components are wanted, so groups aren't expanded into pairs. A bucket's smallest member is its hub. First each document is compared
with the hub that it shares most buckets with. Then, where a bucket still holds different components, sketches are compared across
them, block against block, each pair in the first bucket that it shares; pairs with an estimate far below the threshold or with set sizes
that can't reach it can't link. Documents that the others chain together in one block are compared by their whole sets, in blocks that are
bounded by documents and by shingles. Blocks return spanning forests and never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.blockwise import by_group, forest, group_starts, inner_pairs, labels_of
from folio.llm.common import CHUNK, Spill, checkpoint, chunks, release, tidy
from folio.llm.components import components
from folio.llm.hashing import Stretches, Words, mix

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
SYMBOLS, CHUNKS = 64, 16
PER_CHUNK = SYMBOLS // CHUNKS
RADIUS = 2 * CHUNKS - 1
#: Bins of a second sketch, the least hash of each, which sharpens the estimate before whole sets are fetched: at the threshold the share of
#: equal bins among m occupied ones is 0.75 with a deviation of sqrt(0.1875 / m) at most; SIGMAS of them below, a pair can't link.
BINS, SIGMAS = 256, 5
#: Ids (8 bytes each) up to which a list of documents is broadcast; beyond that it is joined.
BROADCAST_IDS = 400_000
#: Pairs that are compared at once; documents and shingles of a part whose whole sets are compared with another's, and shingles at once.
PAIRS = 40_000
SETS, SHINGLES, COLUMNS = 256, 1 << 19, 8192
BLOCK = 2048
U32 = np.uint32
_RNG = np.random.default_rng(11)
_A = _RNG.integers(1, 1 << 31, SYMBOLS).astype(U32) * U32(2) + U32(1)
_B = _RNG.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(U32)


def shingles(lanes: tuple[np.ndarray, np.ndarray], limits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document the distinct shingles, both halves of their names, in the order of the first."""
    n = np.diff(limits)
    many = np.where(n > 0, np.maximum(1, n - WIDTH + 1), 0)
    ends = np.cumsum(many)
    start = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(limits[:-1] - ends + many, many)
    end = np.minimum(start + WIDTH, np.repeat(limits[1:], many))
    halves = [Stretches(lane).of(start, end) for lane in lanes]
    out = []
    for a, z in zip((ends - many).tolist(), ends.tolist(), strict=True):
        order = np.argsort(halves[0][a:z], kind="stable")
        x, y = halves[0][a:z][order], halves[1][a:z][order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        out.append((x[new], y[new]))
    return out


def signature(shingled: np.ndarray) -> bytes:
    """SYMBOLS 16-bit symbols of a set that isn't empty."""
    x = (shingled >> np.uint64(32)).astype(U32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, U32)
    for start in range(0, len(x), 1024):
        h = x[start : start + 1024, None] * _A + _B
        h ^= h >> U32(15)
        h *= U32(0x85EBCA6B)
        h ^= h >> U32(13)
        np.minimum(least, h.min(axis=0), out=least)
    least *= U32(0xC2B2AE35)
    least ^= least >> U32(16)
    return least.astype("<u2").tobytes()


_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - int(np.log2(BINS)))).astype(np.uint64)


def binned(shingled: np.ndarray) -> bytes:
    """For each of BINS equal ranges of hashes 8 bits of the least hash in it, 0 for none."""
    at = np.searchsorted(shingled, _EDGES)
    end = np.append(at[1:], len(shingled))
    least = shingled[np.minimum(at, len(shingled) - 1)]
    return np.where(at < end, (mix(least) % np.uint64(255) + np.uint64(1)), np.uint64(0)).astype(np.uint8).tobytes()


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """Rows x (SYMBOLS) keys: for each chunk, each symbol of it left out once. A key's last bits say which."""
    rows = len(signatures)
    cut = signatures.reshape(rows, CHUNKS, PER_CHUNK).astype(np.uint64)
    out = np.empty((rows, CHUNKS, PER_CHUNK), np.uint64)
    for left_out in range(PER_CHUNK):
        code = np.zeros((rows, CHUNKS), np.uint64)
        for k in range(PER_CHUNK):
            if k != left_out:
                code = (code << np.uint64(16)) | cut[:, :, k]
        place = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(PER_CHUNK) + np.uint64(left_out)
        out[:, :, left_out] = mix(code ^ mix(place + np.uint64(1))) & ~np.uint64(SYMBOLS - 1) | place
    return out.reshape(rows, SYMBOLS).astype(np.int64)


def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which key each of some aligned pairs of signatures shares first; SYMBOLS for pairs without one."""
    apart = (x != y).reshape(len(x), CHUNKS, PER_CHUNK)
    close = apart.sum(axis=2) <= 1
    chunk = close.argmax(axis=1)
    left_out = apart[np.arange(len(x)), chunk].argmax(axis=1)
    return np.where(close.any(axis=1), chunk * PER_CHUNK + left_out, SYMBOLS)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[tuple[np.ndarray, np.ndarray]]]]:
    for b in batches:
        for ids, texts in chunks(b.column(0).to_pylist(), b.column(1), CHUNK):
            words = Words(texts, lower=True)
            yield ids, shingles(words.names(), words.limits)


def _set_key(items: tuple[np.ndarray, np.ndarray]) -> bytes | None:
    x, y = items
    return hashlib.blake2b(x.tobytes() + y.tobytes(), digest_size=16).digest() if len(x) else None


def sketch(docs: DataFrame) -> DataFrame:
    """id, n_shingles, set_key (null for an empty set), sig, extra of rows id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches):
            both = [(signature(x), binned(x)) if len(x) else (None, None) for x, _ in sets]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(x) for x, _ in sets], pa.int64()), pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([s for s, _ in both], pa.binary()), pa.array([e for _, e in both], pa.binary())], names=["id", "n_shingles", "set_key", "sig", "extra"])

    return docs.select("id", F.col("text").cast("binary")).mapInArrow(tidy(run), "id long, n_shingles long, set_key binary, sig binary, extra binary")


def _whole_sets(docs: DataFrame) -> DataFrame:
    """set_key, items (first halves of all names, then second halves) of rows id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            yield pa.record_batch([pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([x.tobytes() + y.tobytes() for x, y in sets], pa.binary())], names=["set_key", "items"])

    return docs.select("id", F.col("text").cast("binary")).mapInArrow(tidy(run), "set_key binary, items binary")


def _halves(items: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(items.as_buffer(), np.uint64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _keys(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sigs = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(b.num_rows, SYMBOLS)
                yield pa.record_batch([pa.array(keys_of(sigs).ravel()), pa.array(np.repeat(np.asarray(b.column(0)), SYMBOLS))], names=["key", "id"])

    return reps.select("id", "sig").mapInArrow(tidy(run), "key long, id long")


def _passing(n: tuple, extra: tuple, sig: tuple | None = None) -> np.ndarray:
    """Which of some aligned pairs can still link, by set sizes, bins and, if given, signatures of both sides."""
    ok = np.flatnonzero(100 * np.minimum(*n) >= PERCENT * np.maximum(*n))
    out = np.zeros(len(n[0]), bool)
    for start in range(0, len(ok), PAIRS):
        at = ok[start : start + PAIRS]
        if sig is not None:
            at = at[(sig[0][at] != sig[1][at]).sum(axis=1) <= RADIUS]
        x, y = extra[0][at], extra[1][at]
        some = (x > 0) | (y > 0)
        many = some.sum(axis=1)
        out[at] = ((x == y) & some).sum(axis=1) >= 0.75 * many - SIGMAS * np.sqrt(0.1875 * many)
    return out


def _arrays(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sig").alias(f"s{c}"), F.col("extra").alias(f"x{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = tuple(np.asarray(b.column(i)) for i in (2, 3))
                ok = pa.array(_passing(n, tuple(_arrays(b.column(i), np.uint8, BINS) for i in (6, 7)), tuple(_arrays(b.column(i), "<u2", SYMBOLS) for i in (4, 5))))
                yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return joined.select("a", "b", "na", "nb", "sa", "sb", "xa", "xb").mapInArrow(tidy(run), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("items").alias(f"i{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = sorted((_halves(x), _halves(y)), key=lambda s: len(s[0]))
                at = np.minimum(np.searchsorted(q[0], p[0]), len(q[0]) - 1)
                both = int(((q[0][at] == p[0]) & (q[1][at] == p[1])).sum())
                keep.append(100 * both >= PERCENT * (len(p[0]) + len(q[0]) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return joined.select("a", "b", "ia", "ib").mapInArrow(tidy(run), "a long, b long")


def _across(members: DataFrame, reps: DataFrame) -> DataFrame:
    """id, cluster: documents of different components of one bucket (members: key, id, component) that candidate pairs chain together
    in one pair of blocks. A pair counts in the first bucket that it shares."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    sizes = checkpoint(sizes.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    placed = members.join(sizes, "key").withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.join(reps.select("id", F.col("n_shingles").alias("n"), "extra", "sig"), "id")
    placed = placed.select("key", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "p", "id", "component", "n", "extra", "sig")

    def compare(group: pa.Table) -> pa.RecordBatch:
        key, lo, hi, part, ids, component, n = (group.column(i).to_numpy() for i in range(7))
        extra, sig = _arrays(group.column(7), np.uint8, BINS), _arrays(group.column(8), "<u2", SYMBOLS)
        starts = group_starts(key, lo, hi)
        found = [np.zeros((2, 0), np.int64)]
        for x, y in inner_pairs(starts, np.diff(np.append(starts, len(key))), PAIRS):
            ok = (component[x] != component[y]) & ((lo[x] == hi[x]) | (part[x] != part[y]))
            x, y = x[ok], y[ok]
            ok = _passing((n[x], n[y]), (extra[x], extra[y]))
            x, y = x[ok], y[ok]
            ok = first_shared(sig[x], sig[y]) == key[x] % SYMBOLS
            found.append(np.stack([x[ok], y[ok]]))
        rows, root = labels_of(np.concatenate(found, axis=1))
        name = mix(key.astype(np.uint64)[root] ^ mix((lo[root] << 32 | hi[root]).astype(np.uint64) ^ mix(ids[root].astype(np.uint64))))
        return pa.record_batch([pa.array(ids[rows]), pa.array(name.astype(np.int64))], names=["id", "cluster"])

    return by_group(placed, compare, "id long, cluster long")


def _linked_sets(items: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which of some sets link with each other, by products of their membership tables."""
    sizes = np.array([len(x) for x, _ in items])
    owner = np.repeat(np.arange(len(items)), sizes)
    first, second = (np.concatenate(h) for h in zip(*items, strict=True))
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
    column = np.cumsum(new) - 1
    owner = owner[order]
    # Shingles of one set alone are in no intersection.
    shared = np.bincount(column) > 1
    place = np.cumsum(shared) - 1
    some = shared[column]
    owner, column = owner[some], place[column[some]]
    both = np.zeros((len(items), len(items)))
    for start in range(0, int(shared.sum()), COLUMNS):
        a, z = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(items), COLUMNS), np.float32)
        dense[owner[a:z], column[a:z] - start] = 1
        both += dense @ dense.T
    return 100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both)


def _inside(clusters: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links, as forests, between documents of one cluster (id, cluster) and different components."""
    own = clusters.join(labels, "id", "left").join(reps.select("id", "n_shingles"), "id").select("id", "cluster", F.coalesce("component", "id").alias("component"), "n_shingles")
    parts = F.ceil(F.greatest(F.count("*") / SETS, F.sum("n_shingles") / SHINGLES)).cast("int")
    sizes = checkpoint(own.groupBy("cluster").agg(parts.alias("parts")))
    placed = own.join(sizes, "cluster").withColumn("p", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int"))
    placed = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(sets, "id")
    placed = placed.select("cluster", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "p", "id", "component", "items")

    def compare(group: pa.Table) -> pa.RecordBatch:
        cluster, lo, hi, part, ids, component = (group.column(i).to_numpy() for i in range(6))
        starts = group_starts(cluster, lo, hi)
        found = [np.zeros((2, 0), np.int64)]
        for a, z in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            linked = _linked_sets([_halves(x) for x in group.column(6).slice(a, z - a)])
            x, y = np.nonzero(np.triu(linked, 1))
            ok = (component[a:z][x] != component[a:z][y]) & ((lo[a] == hi[a]) | (part[a:z][x] != part[a:z][y]))
            found.append(np.stack([ids[a:z][x[ok]], ids[a:z][y[ok]]]))
        return forest(np.concatenate(found, axis=1))

    return by_group(placed, compare)


class _Sets:
    """Whole sets, computed once for each document that needs to be compared."""

    def __init__(self, source: DataFrame, reps: DataFrame, spills: list[Spill]):
        self.source, self.reps, self.spills, self.sets = source, reps, spills, None

    def of(self, wanted: DataFrame) -> DataFrame:
        """Whole sets (id, items), of the representatives in ``wanted`` at least."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("id"), "id", "left_anti")
        wanted = checkpoint(wanted.join(self.reps, "id").select("id", "set_key", "doc"))
        docs = wanted.select(F.col("doc").alias("id")).distinct()
        few = wanted.count() <= BROADCAST_IDS
        found = _whole_sets(self.source.join(F.broadcast(docs) if few else docs, "id", "left_semi")).dropDuplicates(["set_key"])
        new = Spill(found.join(wanted, "set_key").select("id", "items"))
        self.spills.append(new)
        self.sets = new.df if self.sets is None else self.sets.unionAll(new.df)
        return self.sets


def _repeated_ids(table: DataFrame) -> DataFrame:
    """Ids whose rows have different sets, or some of them none."""
    key = F.xxhash64("set_key")
    sets = F.count("set_key")
    seen = table.where("id is not null").groupBy("id").agg(F.min(F.when(F.col("set_key").isNotNull(), key)).alias("lo"), F.max(F.when(F.col("set_key").isNotNull(), key)).alias("hi"), sets.alias("sets"), F.count("*").alias("n"))
    return seen.where("lo <> hi or sets between 1 and n - 1").select("id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept: a row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after folding A-Z; a text of fewer than WIDTH words is one shingle; null, empty and blank
    texts have no shingle, link with nothing and are kept. Equal sets link. Rows that repeat a doc_id, with one text or several, are one node:
    each text's links are the node's, and all of its rows share its component; rows without an id link with nothing and are kept. Of equally
    good documents the smallest id stays. Extra columns are ignored, whatever their names; an empty table gives an empty one. Sets are whole:
    no prefix, no cap on buckets.
    """
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    table = Spill(sketch(source))
    spills = [table]
    firsts = table.df.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("doc"), F.first("sig").alias("sig"), F.first("extra").alias("extra"), F.first("n_shingles").alias("n_shingles"))
    # One node for each set; its number stands for it from here on.
    reps = checkpoint(firsts.withColumn("id", F.monotonically_increasing_id()))
    keys = _keys(reps)
    hubs = checkpoint(keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"))
    members = Spill(keys.join(hubs, "key").select("key", "a", "id"))
    spills.append(members)
    del keys, hubs
    release(docs.sparkSession)
    pairs = members.df.where("a < id").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("n"))
    sets = _Sets(source, reps, spills)
    best = pairs.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    candidates = checkpoint(_near(best, reps))
    edges = checkpoint(_confirmed(candidates, sets.of(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct())))
    again = checkpoint(_repeated_ids(table.df))
    some_again = not again.isEmpty()
    if some_again:
        owned = table.df.join(again, "id", "left_semi").select(F.col("id").alias("doc"), "set_key").distinct().join(reps.select("set_key", "id"), "set_key").select("doc", "id")
        least = owned.groupBy("doc").agg(F.min("id").alias("b"))
        edges = checkpoint(edges.unionAll(owned.join(least, "doc").where("id > b").select(F.col("id").alias("a"), "b")))
    labels = checkpoint(components(edges))
    release(docs.sparkSession)
    by_component = members.df.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    clusters = checkpoint(_across(by_component, reps))
    release(docs.sparkSession)
    if not clusters.isEmpty():
        found = checkpoint(_inside(clusters, labels, reps, sets.of(clusters.select("id").distinct())))
        if not found.isEmpty():
            labels = checkpoint(components(edges.unionAll(found)))
    labelled = checkpoint(reps.select("set_key", "doc", "id").join(labels, "id", "left").select("set_key", "doc", F.coalesce("component", "id").alias("component")))
    smallest = labelled.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_set = checkpoint(labelled.join(smallest, "component").select("set_key", "component_id"))
    out = table.df.select("id", "n_shingles", "set_key").join(by_set, "set_key", "left")
    if some_again:
        by_id = checkpoint(table.df.join(again, "id", "left_semi").join(by_set, "set_key").groupBy("id").agg(F.min("component_id").alias("own")))
        out = out.join(by_id, "id", "left").withColumn("component_id", F.coalesce("own", "component_id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = checkpoint(out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))
    for s in spills:
        s.drop()
    return out
