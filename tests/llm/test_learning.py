"""Toxicity on planted words, mixing against its totals, and the pipeline against its stages' plain meaning."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import mixing, toxicity

INSULTS = ["zorgle", "fribbex", "quandop"]


def labelled(n=900, seed=6):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvy") for _ in range(rng.randrange(2, 9))) for _ in range(700)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((i, " ".join(words[:20]) + ".\n" + " ".join(words[20:])))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def machine(spark):
    docs, labels = labelled()
    return toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_documents(spark, machine):
    docs, labels = labelled()
    scored = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), machine).withColumn("held", toxicity.held_out()).collect()
    truth = dict(labels)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    held = [r for r in scored if r["held"]]
    assert sum((r["score"] >= toxicity.CUT) == bool(truth[r["doc_id"]]) for r in held) >= 0.98 * len(held)


def test_gaps_and_insertions(machine):
    scorer = toxicity.Scorer(machine)
    value = lambda t: float(scorer.evidence([t])[0, 0])
    clean = value("harmless words only")
    for variant in ("zorgle", "ZORGLE!!", "z o r g l e", "z.o.r.g.l.e", "zorxgle", "zorggle", "zorgles", "z0rgle"):
        assert value(variant) > clean + 0.5, variant


def test_decisions_are_the_kernel_expansion():
    """The tabulated decision equals the sum over landmarks of kernels computed pair by pair."""
    words = ["idiot", "moron", "banana", "table", "idioot"]
    rows = toxicity.explicit(toxicity.coded(words))
    gram = toxicity._gram(rows, rows)
    for (a, x), (b, y) in itertools.product(enumerate(words), repeat=2):
        total = 0.0
        for order in toxicity.ORDERS:
            p, q = ("\0" + x + "\0", "\0" + y + "\0")
            for s, t in itertools.product(itertools.combinations(range(len(p)), order), itertools.combinations(range(len(q)), order)):
                if s[-1] - s[0] < order + toxicity.GAPS and t[-1] - t[0] < order + toxicity.GAPS and all(p[i] == q[j] for i, j in zip(s, t, strict=True)):
                    total += toxicity.DECAY ** (s[-1] - s[0] + t[-1] - t[0] + 2) / (norm(len(p), order) * norm(len(q), order))
        assert abs(gram[a, b] - total) < 1e-9
    m = toxicity.train_machine(["idiot", "moron"], ["banana", "table"])
    assert (m.decide(["idiot", "moron"]) > m.decide(["banana", "table"])).all()


def norm(n, order):
    return np.sqrt(sum(toxicity.DECAY ** (2 * (s[-1] - s[0] + 1)) for s in itertools.combinations(range(n), order) if s[-1] - s[0] < order + toxicity.GAPS)) or 1.0


def test_odd_rows(spark, machine):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "zorgle fribbex zorgle", 0.5), (3, "zorgle fribbex zorgle", 0.5), (None, "b" * 100_000, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = toxicity.score(df, machine).collect()
    assert len(got) == 5
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [r["score"] >= toxicity.CUT for r in got if r["doc_id"] == 3] == [True, True]
    assert {r["doc_id"] for r in toxicity.clean(df, machine).collect()} == {1, 2, None}
    assert toxicity.score(df.limit(0), machine).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, None)], [(None, 1)]):
        m = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.clean(docs, m).count() == 2


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_totals(seed):
    rng = np.random.default_rng(seed)
    size = np.exp(rng.normal(5, 1, 500)).astype(int)
    p = rng.uniform(0.05, 0.95, 500)
    q = mixing.flight(p, size, rng)
    open_ = (q > 0) & (q < 1)
    assert open_.sum() <= 2
    assert abs((q - p) @ size) < 1e-5 * size.sum()
    assert abs((q - p).sum()) < 1e-6


def test_flight_keeps_expectations():
    size = np.array([3, 10, 7, 1, 4, 9, 2, 8])
    p = np.array([0.2, 0.5, 0.7, 0.4, 0.9, 0.3, 0.5, 0.6])
    mean = np.mean([mixing.flight(p, size, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def plain_targets(sizes):
    """Shares by hand: fill, cap, and share what is over again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out | {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    rng = random.Random(3)
    rows = []
    for i in range(900):
        source = rng.choice(["b", "b", "b", "a", "é", "Z", None, "\U0001f600", "empty"])
        words = 0 if source == "empty" else int(rng.lognormvariate(3, 1))
        rows.append((i, " ".join("w" * words) if words else rng.choice(["", None, " \t"]), source, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] == r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(2, 0.03 * goal[s])
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_odd_rows(spark):
    rows = [(1, None, None), (1, "a b", None), (2, "", "x"), (3, "c", "x"), (None, "d d", "y"), (3, "c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    assert mixed.count() == 6
    assert mixing.take(df).count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.take(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Toxic documents go, one of each group stays, secrets are masked, the mix holds, and what is encoded decodes."""
    import public_tokenizers

    import corpus_pipeline
    from folio.llm import spm

    docs, labels = labelled(400)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs]
    rows += [(1000 + k, rows[4 * k + 1][1], "en", "s1", 0) for k in range(20)]
    rows += [(2000 + k, f"note {k} says password: abcdefgh{k} to nobody else but me", "en", "s2", 0) for k in range(5)]
    rows += [(3000, None, "en", "s0", None), (3001, "", None, None, 0), (None, "no id but words", "en", "s0", 15), (None, "no id either", "en", "s0", 12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = now.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = now
        if k < 4:
            assert now.columns == columns
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in seen.items()}
    toxic = {i for i, y in labels if y}
    assert len(toxic & set(ids["toxicity"])) <= 0.05 * len(toxic)
    assert len({i for i, y in labels if not y} - set(ids["toxicity"])) <= 4
    assert len(ids["minhash_near_dedup"]) == len(set(ids["minhash_near_dedup"])) + 1
    assert not {1000 + k for k in range(20)} & set(ids["minhash_near_dedup"])
    assert {3000, 3001} <= set(ids["minhash_near_dedup"])
    assert ids["secret_scans"].count(None) == 2
    masked = {r["doc_id"]: r["text"] for r in seen["secret_scans"].collect()}
    assert all("abcdefgh" not in masked[2000 + k] and "nobody else" in masked[2000 + k] for k in range(5) if 2000 + k in masked)
    taken = {i: ids["mixing"].count(i) for i in set(ids["mixing"]) if i is not None}
    assert max(taken.values()) <= 2
    texts = {(r["doc_id"], r["text"] or "") for r in seen["mixing"].collect()}
    assert {(r["doc_id"], r["text"]) for r in spm.decode(seen["sentencepiece"], public_tokenizers.path("piece_bpe_32k.model")).collect()} == texts
