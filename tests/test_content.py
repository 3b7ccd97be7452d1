"""Content streams against a plain interpreter with matrices of numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest

from folio.operators import content


def plain(ops):
    """The same by 3 x 3 matrices and a stack of dictionaries."""
    full = lambda m: np.array([[m[0], m[1], 0], [m[2], m[3], 0], [m[4], m[5], 1.0]])
    now, stack, line, out = {"m": np.eye(3), "fill": (0, 0, 0), "size": 0.0, "lead": 0.0}, [], np.eye(3), []
    move = lambda x, y: full((1, 0, 0, 1, x, y))
    for seq, op, args, text in ops:
        if op == "q":
            stack.append(dict(now))
        elif op == "Q" and stack:
            now = stack.pop()
        elif op == "cm":
            now["m"] = full(args) @ now["m"]
        elif op == "BT":
            line = np.eye(3)
        elif op == "Tf":
            now["size"] = args[-1]
        elif op == "TL":
            now["lead"] = args[0]
        elif op in ("Td", "TD"):
            if op == "TD":
                now["lead"] = -args[1]
            line = move(*args) @ line
        elif op == "Tm":
            line = full(args)
        elif op in ("T*", "'"):
            line = move(0, -now["lead"]) @ line
        elif op == "g":
            now["fill"] = (args[0],) * 3
        elif op == "rg":
            now["fill"] = tuple(args)
        if op in ("Tj", "'"):
            at = line @ now["m"]
            out.append((seq, text, at[2, 0], at[2, 1], now["size"] * abs(np.linalg.det(at[:2, :2])) ** 0.5, "".join(f"{round(255 * v):02X}" for v in now["fill"]), len(stack)))
    return out


def stream(seed, n=120):
    rng = random.Random(seed)
    matrix = lambda: [rng.choice([1.0, 0.5, 2.0, -1.0]), rng.choice([0.0, 0.3]), rng.choice([0.0, -0.2]), rng.choice([1.0, 1.5]), rng.uniform(-9, 9), rng.uniform(-9, 9)]
    make = {"q": list, "Q": list, "cm": matrix, "BT": list, "Tf": lambda: [rng.uniform(6, 20)], "TL": lambda: [rng.uniform(8, 14)], "Td": lambda: [rng.uniform(-5, 5), rng.uniform(-5, 5)], "TD": lambda: [1.0, -12.0], "Tm": matrix, "T*": list, "g": lambda: [rng.random()], "rg": lambda: [rng.random() for _ in range(3)], "Tj": list, "'": list, "re": lambda: [1.0, 2.0, 3.0, 4.0]}
    return [(i, op, make[op](), f"t{i}" if op in ("Tj", "'") else None) for i, op in enumerate(rng.choices(list(make), k=n))]


def close(got, wanted):
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted, strict=True):
        assert (a[0], a[1], a[5], a[6]) == (b[0], b[1], b[5], b[6])
        assert a[2:5] == pytest.approx(b[2:5], abs=1e-9)


@pytest.mark.parametrize("seed", range(20))
def test_streams(seed):
    close(list(content.painted(stream(seed))), plain(stream(seed)))


def test_broken_streams():
    ops = [(0, "Q", [], None), (1, "cm", [1.0], None), (2, "Td", None, None), (3, "Tj", None, None), (4, "rg", [2.0, -1.0, 0.5], None), (5, "Tj", [], "x")]
    assert [p[1:4] + p[5:] for p in content.painted(ops)] == [("", 0.0, 0.0, "000000", 0), ("x", 0.0, 0.0, "FF0080", 0)]


def test_pages(spark):
    rows = [(d, p, *op) for d in (1, 2) for p in (1, 2) for op in stream(10 * d + p)]
    df = spark.createDataFrame(rows, "doc_id long, page long, seq long, op string, args array<double>, text string").repartition(5)
    got = content.texts(df).collect()
    for d, p in ((1, 1), (1, 2), (2, 1), (2, 2)):
        close(sorted(tuple(r)[2:] for r in got if (r["doc_id"], r["page"]) == (d, p)), plain(stream(10 * d + p)))
    assert content.texts(df.limit(0)).count() == 0
