"""A source's words come within a few of its target, whatever the other sources have."""

from __future__ import annotations

import random

from folio.llm import mixing


def test_sources_of_few_blocks_beside_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 120)
    rng = random.Random(8)
    rows = [(i, " ".join("w" * int(rng.lognormvariate(5, 1))), "hot" if i < 300 else f"s{i % 8}") for i in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0,), share=0.3).collect()
    off = {}
    for r in got:
        off[r["source"]] = off.get(r["source"], -r["target"]) + r["taken"]
    assert len(got) == 1000 and len(off) == 9
    assert max(map(abs, off.values())) <= 10, off
