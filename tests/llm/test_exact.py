"""Texts made to mislead hashes, rows without ids, repeated ids and very long texts, against brute force."""

from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import pytest

from folio.llm import embed_dedup, hashing, minhash, recompression
from tests.llm.test_dedup import Union, brute_repeats, brute_vectors


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


WORDS = [(thue_morse(n), thue_morse(n, "ba")) for n in (512, 1024, 4096)]


def test_names_of_words_and_stretches_follow_no_pattern():
    names, _ = hashing.word_hashes([" ".join(w).encode() for w in WORDS])
    assert len(set(names.tolist())) == 6
    pattern = np.array([bin(i).count("1") & 1 for i in range(2048)])
    lane = np.concatenate([names[pattern], names[1 - pattern]])
    stretches = hashing.Stretches(lane)
    for n in (5, 35, 255, 289):
        start = np.arange(len(lane) - n + 1)
        got = collections.defaultdict(set)
        for i, x in zip(start.tolist(), stretches.of(start, start + n).tolist(), strict=True):
            got[x].add(lane[i : i + n].tobytes())
        assert all(len(v) == 1 for v in got.values())


def test_words_without_some():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b" \t\nabAB\xc3") for _ in range(rng.randrange(40))) for _ in range(300)] + [None, b"", b" a", b"a "]
    words = hashing.Words(texts)
    gone = np.array([rng.random() < 0.4 for _ in range(len(words))])
    wanted = [b" ".join(w for w, g in zip((t or b"").split(), gone[a:z], strict=True) if not g) for t, a, z in zip(texts, words.limits[:-1], words.limits[1:], strict=True)]
    assert words.without(gone) == wanted


def test_repeats_of_misleading_words_and_rows_without_ids(spark):
    forty = " ".join(f"f{i}" for i in range(40))
    rows = [(2 * k + j, f"{w[j]} {forty}{k}") for k, w in enumerate(WORDS) for j in (0, 1)]
    rows += [(None, " ".join(f"n{k}x{i}" for i in range(36))) for k in range(50)]
    rows += [(None, None), (None, ""), (0, "zero " * 40), (None, " ".join(f"n7x{i}" for i in range(36))), (0, " ".join(f"q{i}" for i in range(50)))]
    rows += [(77, " ".join(f"r{i}" for i in range(60)))] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    marked = [((-1 if i is None else i), t) for i, t in rows]
    wanted = sorted(((None if i == -1 else i, *r) for i, *r in brute_repeats(marked)), key=key)
    assert sorted(map(tuple, recompression.remove_repeats(df, texts=False).collect()), key=key) == wanted


@pytest.mark.parametrize("segment", [40, 64])
def test_a_long_text_is_read_in_stretches(spark, segment, monkeypatch):
    rng = random.Random(segment)
    long = [f"w{rng.randrange(9)}" for _ in range(1500)]
    long[900:1000] = long[100:200]
    rows = [(1, " ".join(long)), (2, " ".join(long[300:345])), (3, " ".join(long[630:664])), (4, "x " * 200)]
    texts = [t.encode() for _, t in rows]
    words = hashing.Words(texts)
    whole = recompression.clusters(words.names(), words.limits)
    monkeypatch.setattr(recompression, "SEGMENT", segment)
    cut = recompression.clusters(words.names(), words.limits)
    # What each window is filed under doesn't depend on where stretches end.
    filed = lambda c: {(d, s + k, name) for name, d, s, n in zip(c[0].tolist(), c[3].tolist(), c[4].tolist(), c[5].tolist(), strict=True) for k in range(n)}
    assert filed(whole) == filed(cut)
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def run(batches):
        import pyarrow as pa

        from folio.llm import recompression as r

        r.SEGMENT = segment
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = hashing.Words([t.encode()])
                c = r.clusters(w.names(), w.limits)
                yield pa.record_batch([pa.array([i]), pa.array([int(c[5].sum())])], names=["id", "n"])

    counted = {r["id"]: r["n"] for r in df.mapInArrow(run, "id long, n long").collect()}
    assert counted == {1: 1466, 2: 11, 3: 0, 4: 166}
    assert sorted(map(tuple, recompression.remove_repeats(df, texts=False).collect())) == brute_repeats(rows)


def brute_nodes(rows):
    """Rows that repeat an id are one node; a text's links are the node's."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    u = Union({i for i, _ in rows})
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            u.link(rows[a][0], rows[b][0])
    return sorted((i, len(s), u.root(i), u.root(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def test_links_of_misleading_words_and_repeated_ids(spark):
    rows = [(2 * k + j, f"{w[j]} x y z") for k, w in enumerate(WORDS) for j in (0, 1)]
    text = lambda s, n=30: " ".join(f"{s}{i}" for i in range(n))
    rows += [(50, text("a")), (50, text("b")), (50, text("b")), (40, text("a") + " more"), (60, text("b")), (61, None), (61, text("c")), (61, ""), (62, text("c")), (63, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, minhash.dedup(df).collect())) == brute_nodes(rows)


def test_first_shared_key():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (400, minhash.SYMBOLS)).astype("<u2")
    y = np.where(rng.random(x.shape) < 0.45, rng.integers(3, 9, x.shape), x).astype("<u2")
    shared = minhash.keys_of(x) == minhash.keys_of(y)
    wanted = np.where(shared.any(axis=1), shared.argmax(axis=1), minhash.SYMBOLS)
    assert minhash.first_shared(x, y).tolist() == wanted.tolist()
    assert (minhash.keys_of(x) % minhash.SYMBOLS == np.arange(minhash.SYMBOLS)).all()


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (1, [0.0, 1.0]), (3, [0.01, 1.0]), (4, [0.02, 1.0]), (5, [-1.0, 0.0]), (5, None), (5, [-1.0, 0.0]), (6, [-1.0, 0.3]), (7, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0])], "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in embed_dedup.links(df).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute_vectors(rows)
    assert [r for r in got if r[0] is None] == [(None, 0, None, True)]
