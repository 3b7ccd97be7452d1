"""The operators that work row by row: nulls, empty and very long texts, repeated rows, clashing names, empty tables."""

from __future__ import annotations

import public_tokenizers
import pytest

from folio.llm import credentials, media, pii, spm, token_counts

LONG = "word aB3: 4111 1111 1111 1111 x@y.de password=abcdefgh1 \n" * 4_000
ROWS = [(1, None), (2, ""), (3, " \t\n"), (None, "no id"), (4, "twice"), (4, "twice"), (5, LONG), (None, None), (6, "é" * 70_000)]
NAMES = "doc_id long, text string, n_bytes int, media int, ids int, spans int, score int, _id int, _text int, n_tokens int, n_email int, n_hex int, round_trip int"
OPERATORS = {
    "media": lambda d: media.media_features(media.store_texts(d)),
    "tokens": lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "pii": pii.scan,
    "secrets": credentials.scan,
    "pieces": lambda d: spm.encode(d, public_tokenizers.path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    df = spark.createDataFrame([(i, t, *range(11)) for i, t in ROWS], NAMES).repartition(2)
    got = OPERATORS[name](df).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == sorted((i or 0) for i, _ in ROWS)
    twice = [tuple(r) for r in got if r["doc_id"] == 4]
    assert len(twice) == 2 and repr(twice[0]) == repr(twice[1])
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    if name == "media":
        assert (by_id[1]["n_bytes"], by_id[1]["payload_bytes"], by_id[6]["n_bytes"]) == (0, 192, 140_000)
    elif name == "tokens":
        assert by_id[1]["n_tokens"] == by_id[2]["n_tokens"] == 0 and by_id[5]["n_bytes"] == len(LONG)
    elif name == "pii":
        assert (by_id[5]["n_email"], by_id[5]["n_card"], by_id[1]["spans"], by_id[2]["spans"]) == (4_000, 4_000, "", "")
    elif name == "secrets":
        assert (by_id[5]["n_assign"], by_id[1]["spans"]) == (4_000, "")
    else:
        assert (by_id[1]["ids"], by_id[2]["ids"]) == ([], []) and all(r["round_trip"] for r in got)
    assert OPERATORS[name](df.limit(0)).count() == 0
    if name == "secrets":
        assert credentials.redact(df).columns == df.columns and credentials.redact(df.limit(0)).count() == 0
