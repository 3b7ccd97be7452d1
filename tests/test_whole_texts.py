"""Queries look at every row and at whole texts, beyond what the small tables have."""

from __future__ import annotations

import difflib
import random

from folio.operators import compare
from folio.plans import gating, layouts, verifying


def passages(n, seed=3):
    """Passages that all begin alike for more than 60 characters."""
    rng = random.Random(seed)
    head = "the passage that every one of these rows begins with, word for word, "
    return [head + " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4 + i % 3)) for i in range(n)]


def test_similar_text_takes_every_passage_whole(spark, tmp_path):
    texts = passages(215)
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r["key"], r["rank"]): r["candidate"] for r in verifying.similar_text(spark, str(tmp_path)).collect()}
    assert [got[i, 1] for i in range(len(texts))] == texts
    for i in (0, 107, 214):
        assert [got[i, k] for k in (1, 2, 3)] == difflib.get_close_matches(texts[i][:-3], texts, 3, compare.NEAR)


def test_nearest_over_slices(spark, monkeypatch):
    texts = passages(30) + ["abc", "abd", "abc"]
    wanted = [(1, texts[7][:-3]), (2, "abe"), (2, "abe"), (2, texts[20]), (3, None), (4, "")]
    find = lambda: sorted((r["key"], r["rank"], r["candidate"]) for r in compare.nearest(spark.createDataFrame(wanted, "key long, text string"), spark.createDataFrame([(t,) for t in [*texts, None]], "candidate string")).collect())
    plain = sorted((k, i + 1, c) for k, t in wanted for i, c in enumerate(difflib.get_close_matches(t or "", texts, 3, compare.NEAR)))
    assert find() == plain
    monkeypatch.setattr(compare, "MOST_CANDIDATES", 5)
    assert find() == plain


def test_line_wrap_reads_past_400_characters(spark, tmp_path):
    rows = [(1, "word " * 200), (2, "word " * 60), (3, "a b")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # Eight words of four letters and their blanks fill a line of 40.
    assert {r["item_id"]: r["lines"] for r in layouts.line_wrap(spark, str(tmp_path)).collect()} == {1: 25, 2: 8, 3: 1}


def test_table_split_compares_whole_rows(spark, tmp_path):
    def table(doc, last, head):
        """Two pages: the first ends with the row ``last``, the second begins with ``head``. No turn is 1, which has a text of its own."""
        return [(4 * doc + 1, 2, "row"), (4 * doc + 1, 5, "row"), (4 * doc + 1, 7, last), (4 * doc + 2, 2, head)]

    rows = table(1, "the header of one table", "the header of another") + table(2, "the header of one table", "the header of one table")
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [(r["doc_id"], r["page"]) for r in gating.table_split(spark, str(tmp_path)).collect()] == [(2, 2)]


def test_differences_turn_the_old_words_into_the_new(spark):
    rng = random.Random(8)
    words = lambda: [rng.choice("abcdef") for _ in range(rng.randrange(30))]
    rows = [(k, words(), words()) for k in range(60)] + [(60, None, ["x"]), (61, ["x"], None), (62, ["same"], ["same"])]
    found = compare.opcodes(spark.createDataFrame(rows, "key long, old array<string>, new array<string>")).collect()
    for key, old, new in rows:
        old, new = old or [], new or []
        out, at = [], 0
        for r in sorted((r for r in found if r["key"] == key), key=lambda r: (r["old0"], r["new0"])):
            out += old[at : r["old0"]] + new[r["new0"] : r["new1"]]
            at = r["old1"]
        assert out + old[at:] == new
        plain = [c for c in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if c[0] != "equal"]
        assert [tuple(r)[1:] for r in found if r["key"] == key] == plain
