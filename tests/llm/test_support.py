"""What training learned about a unit stays, however many others a process has looked at."""

from __future__ import annotations

import numpy as np

from folio.llm import toxicity


def test_learned_support_outlives_the_memo(monkeypatch):
    monkeypatch.setattr(toxicity, "MEMO", 20)
    machine = toxicity.Machine({}, 0.0, support={"zorgle": 3.0, "fribbex": 1.5}, marks=[("zorgle", 3.0)])
    before = {u: machine.supported(u) for u in ("zorgle", "fribbex", "zorgles", "banana")}
    assert before["zorgle"] == 3.0 and before["fribbex"] == 1.5 and 0 < before["zorgles"] < 3.0 and before["banana"] == 0.0
    for i in range(100):
        machine.supported("".join(chr(97 + int(c)) for c in f"{i:06d}"))
    assert {u: machine.supported(u) for u in before} == before
    assert machine.support == {"zorgle": 3.0, "fribbex": 1.5}
    assert len(machine.lent) <= toxicity.MEMO


def test_no_marks():
    machine = toxicity.Machine({}, 0.0, curve=np.zeros(5), support={"zorgle": 3.0})
    assert [machine.supported(u) for u in ("zorgle", "banana")] == [3.0, 0.0]
    assert not machine.lent
