"""Edits: exact counts or refusal, order, and the invariants that a batch keeps."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import edits
from folio.operators.edits import Op, Refused

ROWS = [(1, 0, "heading", 0, "A"), (1, 1, "paragraph", None, "one fish"), (1, 2, "heading", 1, "B"), (1, 3, "paragraph", None, "two fish"), (1, 4, "heading", 0, "C"), (2, 0, "paragraph", None, "only")]


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(ROWS, "doc_id long, block_ix int, kind string, level int, text string")


def texts(df, doc=1):
    return [r["text"] for r in df.where(F.col("doc_id") == doc).orderBy("block_ix").collect()]


@pytest.mark.parametrize(
    ("op", "expected"),
    [
        (Op("delete", {"block": 1, "to": 2}), ["A", "two fish", "C"]),
        (Op("delete", {"block": -1}), ["A", "one fish", "B", "two fish"]),
        (Op("delete_section", {"heading": 0}), ["C"]),
        (Op("delete_section", {"heading": "B"}), ["A", "one fish", "C"]),
        (Op("move", {"block": 0, "to": 1, "after": "two"}), ["B", "two fish", "A", "one fish", "C"]),
        (Op("move", {"block": 4, "before": 0}), ["C", "A", "one fish", "B", "two fish"]),
        (Op("insert", {"after": 0, "text": ["x", "y"]}), ["A", "x", "y", "one fish", "B", "two fish", "C"]),
        (Op("insert", {"before": "one", "text": "x"}), ["A", "x", "one fish", "B", "two fish", "C"]),
        (Op("replace", {"find": "fish", "replace": "cat", "count": 2}), ["A", "one cat", "B", "two cat", "C"]),
        (Op("set_text", {"block": "two", "text": "new"}), ["A", "one fish", "B", "new", "C"]),
    ],
)
def test_op(blocks, op, expected):
    out, errors = edits.apply(blocks, [op])
    assert texts(out) == expected
    assert 1 not in [r["doc_id"] for r in errors.collect()]
    assert [r["block_ix"] for r in out.where("doc_id = 1").orderBy("block_ix").collect()] == list(range(len(expected)))


@pytest.mark.parametrize(
    "op",
    [
        Op("set_text", {"block": "fish", "text": "x"}),
        Op("replace", {"find": "fish", "replace": "x"}),
        Op("delete", {"block": 3, "to": 1}),
        Op("delete", {"block": 0, "to": -1}),
        Op("move", {"block": 0, "to": 2, "after": 1}),
        Op("delete_section", {"heading": 1}),
        Op("insert", {"after": 99, "text": "x"}),
    ],
)
def test_refusal_leaves_the_whole_batch_undone(blocks, op):
    out, errors = edits.apply(blocks, [Op("insert", {"after": 0, "text": "kept?"}), op])
    assert texts(out) == [r[4] for r in ROWS if r[0] == 1]
    assert (1, 1) in [tuple(r) for r in errors.collect()]


@pytest.mark.parametrize("op", [Op("fly"), Op("delete"), Op("insert", {"text": "x"}), Op("insert", {"text": "x", "after": 0, "before": 1}), Op("delete", {"block": True}), Op("delete", {"block": 0.5}), Op("delete", {"block": ""})])
def test_malformed_ops_are_refused_before_anything_runs(blocks, op):
    with pytest.raises(Refused):
        edits.apply(blocks, [op])


def test_minimal_difference_of_random_texts(spark):
    """Prefix, middle and suffix make up either text again."""
    rng = random.Random(4711)
    pairs = [("".join(rng.choice("абв xy1«—") for _ in range(rng.randrange(28))), "".join(rng.choice("абв xy1«—") for _ in range(rng.randrange(28)))) for _ in range(1000)]
    df = spark.createDataFrame(pairs, "old string, new string")
    for r in df.select("old", "new", edits.minimal(F.col("old"), F.col("new")).alias("m")).collect():
        p, s, m = r["m"]["prefix"], r["m"]["suffix"], r["m"]
        end = lambda t: t[len(t) - s :] if s else ""  # noqa: B023, E731
        assert r["old"][:p] + m["removed"] + end(r["old"]) == r["old"]
        assert r["old"][:p] + m["added"] + end(r["old"]) == r["new"]


def test_revisions(blocks):
    after, _ = edits.apply(blocks, [Op("replace", {"find": "one", "replace": "no"})])
    rows = edits.revisions(blocks, after, "desk", "2026-01-01 00:00:00").collect()
    assert [(r["doc_id"], r["block_ix"], r["kind"], r["removed"], r["added"]) for r in rows] == [(1, 1, "replace", "one", "no")]


def test_runs_split_at_matches(spark):
    runs = spark.createDataFrame([(1, 0, 0, 4, "abcd"), (1, 1, 4, 8, "efgh")], "p long, run_ix int, start long, end long, text string")
    spans = spark.createDataFrame([(1, 2, 6)], "p long, m0 long, m1 long")
    got = [(r["run_ix"], r["text"], r["matched"]) for r in edits.split_runs(runs, spans, ["p"]).orderBy("start").collect()]
    assert got == [(0, "ab", False), (0, "cd", True), (1, "ef", True), (1, "gh", False)]
