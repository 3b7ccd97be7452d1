"""Scores that don't depend on what a process has seen, decisions as sums over landmarks, chances of any size, and taking rows of any names."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import mixing, toxicity


def test_tabulated_decisions_equal_the_sum_over_landmarks():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeimort") for _ in range(rng.randrange(2, 12)))
    positive, negative = sorted({word() for _ in range(60)}), sorted({word() for _ in range(90)})
    landmarks, beta, bias = toxicity._expansion(positive, negative)
    machine = toxicity.train_machine(positive, negative)
    asked = [word() for _ in range(80)] + ["élan", "naïve0"]
    wanted = toxicity._gram(toxicity.explicit(toxicity.coded(asked)), landmarks) @ beta + bias
    assert np.abs(machine.decide(asked) - wanted).max() < 1e-4


def test_chance():
    for t, n, base in ((0, 5, 0.2), (3, 10, 0.3), (10, 10, 0.5), (20, 400, 0.03), (401, 900, 0.4)):
        plain = sum(math.comb(n, k) * base**k * (1 - base) ** (n - k) for k in range(t, n + 1)) if n <= 400 else None
        assert 0 <= toxicity._by_chance(t, n, base) <= 1
        if plain is not None:
            assert toxicity._by_chance(t, n, base) == pytest.approx(plain, rel=1e-6)
    # What happens in half of the cases is no proof, however often it is met.
    assert toxicity._by_chance(5_000, 10_000, 0.5) > 0.4
    assert toxicity._by_chance(9_000, 10_000, 0.5) < 1e-6


def test_scores_do_not_depend_on_the_order_of_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "MEMO", 10)
    rng = random.Random(4)
    words = ["zorgle", "zorgles", "zoorgle", "fribbex", "table", "banana", *("".join(rng.choice("abcorzgle") for _ in range(6)) for _ in range(40))]
    base = toxicity.train_machine(["zorgle", "fribbex"], ["table", "banana", "chair", "window"])
    make = lambda: toxicity.Machine(base.tables, base.bias, support={"zorgle": 3.0, "fribbex": 2.0}, marks=[("zorgle", 3.0)])
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    first = dict(zip(texts, toxicity.Scorer(make()).scores(texts).tolist(), strict=True))
    for _ in range(3):
        rng.shuffle(texts)
        scorer = toxicity.Scorer(make())
        got = {}
        for i in range(0, len(texts), 7):
            got |= dict(zip(texts[i : i + 7], scorer.scores(texts[i : i + 7]).tolist(), strict=True))
        assert got == pytest.approx(first, abs=1e-12)


def test_taken_rows_keep_their_columns_whatever_their_names(spark):
    names = ["doc_id", "text", "source", "i", "t", "s", "k", "row", "copies", "_c"]
    rows = [(None if i % 3 else i, "w " * (i % 9 + 1), None if i % 4 else "a", *range(7)) for i in range(120)] + [(-1, "w", None, *range(7))] * 6
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n in ('text', 'source') else 'long'}" for n in names)).repartition(3)
    out = mixing.take(df)
    assert out.columns == names
    got = out.collect()
    mixed = mixing.mix(df)
    assert len(got) == mixed.agg(F.sum("copies")).first()[0]
    by_text = {(r["doc_id"], r["source"], r["size"]): r["n"] for r in mixed.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n")).collect()}
    seen = {}
    for r in got:
        key = (r["doc_id"], r["source"], len(r["text"].split()))
        seen[key] = seen.get(key, 0) + 1
        assert tuple(r)[3:] == tuple(range(7))
    assert seen == {k: n for k, n in by_text.items() if n}
    assert mixing.take(df.limit(0)).count() == 0
