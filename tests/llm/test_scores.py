"""The toxicity query's scores against a plain computation: every subsequence of every unit by hand, evidence and curve by their definitions."""

from __future__ import annotations

import itertools
import math
import zlib

import pytest

from folio.llm import queries, toxicity
from tests.llm.test_learning import labelled


def decision(machine, unit):
    """The machine's constant and the weights of all subsequences with few gaps, normalised by what the length allows."""
    symbols = [0, *(int(x) for x in toxicity.coded([unit])[0][1:-1]), 0]
    total = machine.bias
    for order in toxicity.ORDERS:
        places = [s for s in itertools.combinations(range(len(symbols)), order) if s[-1] - s[0] < order + toxicity.GAPS]
        norm = math.sqrt(sum(toxicity.DECAY ** (2 * (s[-1] - s[0] + 1)) for s in places)) or 1.0
        for s in places:
            code = 0
            for i in s:
                code = code * toxicity.ALPHABET + symbols[i]
            total += float(machine.tables[order][code]) * toxicity.DECAY ** (s[-1] - s[0] + 1) / norm
    return total


def plain_score(machine, text, known):
    def best(word):
        units = toxicity.units_of_word(word)
        for u in units:
            known.setdefault(u, decision(machine, u))
        return max(units, key=known.__getitem__) if units else None

    own = [u for w in toxicity.words_of(text) if (u := best(w))]
    values = sorted((known[u] for u in set(own)), reverse=True) + [toxicity.NOTHING] * 2
    hits = [u for u in own if known[u] > toxicity.HIT]
    clip = lambda v: min(max(v, toxicity.NOTHING), -toxicity.NOTHING)
    evidence = [clip(values[0]), clip(values[1]), math.log1p(len(hits)), max(map(machine.supported, hits), default=0.0)]
    z = sum(a * b for a, b in zip(evidence, machine.curve, strict=False)) + machine.curve[-1]
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def test_query_scores(spark, tmp_path):
    docs, labels = labelled(300)
    docs += [(1000, None), (1001, ""), (1002, "z.o.r.g.l.e and zorxgle!"), (1003, "a" * 200), (1003, "a" * 200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    machine = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    got = queries.op2_toxicity(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in docs)
    texts, known = dict(docs), {}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["score"] == pytest.approx(plain_score(machine, texts[r["doc_id"]], known), abs=1e-4)
        assert r["predicted"] == int(r["score"] >= 0.7)
