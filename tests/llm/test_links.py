"""Linked credential parts against a comparison of all pairs."""

from __future__ import annotations

import random

import pytest

from folio.llm import credentials as c


def plain(text):
    """All kinds by comparing every part with every other."""
    strong = c.base(text)
    candidates = c.weak(text, strong)
    scope = lambda at: sum(m.start() <= at for m in c._BREAK.finditer(text))
    near = lambda x, parts: any(p != x and scope(p[0]) == scope(x[0]) and p[0] <= x[2] + c.SCOPE and p[2] >= x[0] - c.SCOPE for p in parts)
    inside = lambda x, spans: any(a <= x[0] and x[2] <= b for a, _, b in spans)
    meets = lambda x: any(a < x[2] and x[0] < b for a, _, b in strong)
    others = [x for x in candidates if x[1] != "key"]
    identifiers = [s for s in strong if s[1] == "access"] + [x for x in others if x[1] == "ident"]
    keys = [x for x in candidates if x[1] == "key" and not meets(x) and not inside(x, [o for o in others if o[1] == "endpoint"]) and near(x, identifiers)]
    secrets = keys + [s for s in strong if s[1] == "assign"]
    return sorted((a, k, b) for a, k, b in strong + keys + [x for x in others if near(x, secrets)])


@pytest.mark.parametrize("seed", range(40))
def test_links(seed):
    rng = random.Random(seed)
    key = lambda: "".join(rng.choice("abcXYZ0189+/") for _ in range(rng.choice([19, 22, 40, 200]))) + rng.choice(["", "=="])
    make = [
        lambda: f"user={''.join(rng.choice('abc') for _ in range(rng.randrange(2, 9)))}", lambda: "AKIA" + "".join(rng.choice("ABC012") for _ in range(rng.choice([10, 12, 16]))), key, key,
        lambda: f"password: {key()[: rng.randrange(6, 30)]}", lambda: f"https://host{rng.randrange(9)}/{key()}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([31, 32, 64]))),
        lambda: "plain words " * rng.randrange(1, 40), lambda: "\n\n", lambda: "\n \t\n", lambda: " ",
    ]
    text = " ".join(rng.choice(make)() for _ in range(rng.randrange(2, 60)))
    assert sorted((a, k, b) for k, a, b in c.find(text)) == plain(text)
