"""Near-duplicates, repeats and components against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import embed_dedup, hashing, minhash, recompression
from folio.llm.components import components


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("edges", [[], [(5, 3), (3, 9), (1, 1), (7, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(4, 2), (None, 3), (4, 2)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    real = [(a, b) for a, b in edges if a is not None and b is not None]
    u = Union({x for e in real for x in e})
    for a, b in real:
        u.link(a, b)
    assert {r["id"]: r["component"] for r in components(df).collect()} == {x: u.root(x) for x in u.up}


def plain_words(t):
    return (t or "").encode().lower().split()


def brute_sets(rows):
    sets = {}
    for i, t in rows:
        w = plain_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    u = Union(sets)
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            u.link(a, b)
    return sorted((i, len(s), u.root(i), u.root(i) == i) for i, s in sets.items())


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))) for i in range(n)]
    for i in range(n, 2 * n):
        w = rows[rng.randrange(i)][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    hub = " ".join(rng.choice(words) for _ in range(60)).split()
    for i in range(2 * n, 2 * n + 60):
        w = list(hub)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    return [*rows, (9001, None), (9002, ""), (9003, " \t\n"), (9004, "One TWO"), (9005, "one two"), (9006, "a " * 40_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SETS", 8)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    assert sorted(map(tuple, minhash.dedup(df).collect())) == brute_sets(rows)


def test_minhash_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(2, "a b c"), (2, "a b c"), (1, "A b  c"), (None, "q")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.dedup(df).where("doc_id is not null").collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False)]
    assert minhash.dedup(df.limit(0)).count() == 0


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, minhash.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)] ^= 1
        ka, kb = minhash.keys_of(np.stack([a, b]))
        assert (ka == kb).any()


def brute_repeats(rows, window=35):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeats_corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        v = rng.choice([2, 3, 50, 1000])
        rows.append((i, " ".join(f"w{rng.randrange(v)}" for _ in range(rng.randrange(150)))))
    for i in range(150, 320):
        a, b = rows[rng.randrange(i)][1].split(), rows[rng.randrange(i)][1].split()
        p, q = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        rows.append((i, " ".join(a[p : p + rng.randrange(30, 60)] + b[q : q + rng.randrange(30, 60)])))
    return [*rows, (900, None), (901, ""), (902, "a " * 500), (903, "a " * 34), (904, "a " * 36), (905, "x y " * 300), (906, "x y " * 20), (907, "É é " * 40)]


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats(spark, seed):
    rows = repeats_corpus(seed)
    rows.append(rows[5])
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, place string").repartition(5)
    got = recompression.remove_repeats(df)
    assert sorted(map(tuple, got.drop("kept").collect())) == brute_repeats(rows)
    assert got.where(F.sha2("kept", 256) != F.col("kept_sha256")).count() == 0
    assert recompression.remove_repeats(df.limit(0)).count() == 0


def test_reaches_are_in_order_and_equal_words_get_equal_symbols():
    rng = np.random.default_rng(8)
    inner = rng.integers(0, 30, 400)
    texts = [" ".join(f"t{x}" for x in np.concatenate([rng.integers(0, 30, k), inner, rng.integers(0, 30, k)])).encode() for k in (11, 57)]
    found = []
    for t, k in zip(texts, (11, 57), strict=True):
        words, _ = hashing.word_hashes([t])
        names = set()
        for number, level in enumerate(recompression.levels(words)):
            assert (np.diff(level.low) >= 0).all()
            assert (np.diff(level.high) >= 0).all()
            ok = (level.low >= k) & (level.high <= k + 400)
            names |= {(number, n, a - k, z - k) for n, a, z in zip(level.name[ok].tolist(), level.start[ok].tolist(), level.end[ok].tolist(), strict=True)}
        found.append(names)
    assert found[0] == found[1]
    assert max(n for n, *_ in found[0]) >= 4


def test_hashes_follow_the_words():
    words, starts = hashing.word_hashes([b"a bb\x0bccc", None, b"", b"  bb  A", b"\xc3\xa9\xc2\xa0x"], lower=True)
    assert starts.tolist() == [0, 3, 3, 3, 5, 6]
    assert words[1] == words[3]
    assert words[0] == words[4]
    assert len(set(words.tolist())) == 4


def brute_vectors(rows, threshold=0.9):
    units = {}
    for k, (i, v) in enumerate(rows):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(float)
        units[k] = (i, x / np.linalg.norm(x))
    u = Union({i for i, _ in rows})
    n = collections.Counter()
    for a, b in itertools.combinations(units, 2):
        x, y = units[a][1], units[b][1]
        if len(x) == len(y) and x @ y >= threshold:
            n[a] += 1
            n[b] += 1
            u.link(units[a][0], units[b][0])
    return sorted((i, n[k], u.root(i), u.root(i) == i) for k, (i, _) in enumerate(rows))


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BUCKET", 24)
    monkeypatch.setattr(embed_dedup, "BLOCK", 10)
    monkeypatch.setattr(embed_dedup, "MISS", 1e-9)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 12))
    rows = []
    for i in range(300):
        x = base[rng.integers(40)] * rng.uniform(0.1, 9)
        rows.append((i, (x + rng.standard_normal(12) * rng.choice([0, 0.02, 0.3]) * np.abs(x).mean()).astype(np.float32).tolist()))
    rows += [(500 + i, rows[7][1]) for i in range(30)]
    rows += [(600, None), (601, []), (602, [0.0] * 12), (603, [float("nan")] * 12), (604, [1.0, None] * 6), (605, [float("inf")] * 12), (606, [1.0, 2.0]), (607, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, key int").repartition(3)
    assert sorted(map(tuple, embed_dedup.links(df).collect())) == brute_vectors(rows)
    assert embed_dedup.links(df.limit(0)).count() == 0


def test_bits_and_tables_keep_the_promise():
    for n in (2, 1000, 10**6, 10**9):
        bits, tables = embed_dedup.shape_of(n)
        meet = (1 - np.arccos(embed_dedup.THRESHOLD) / np.pi) ** bits
        assert (1 - meet) ** tables <= embed_dedup.MISS
