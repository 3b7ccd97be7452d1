"""Parts of credentials link at any length."""

from __future__ import annotations

import time

from folio.llm import credentials


def test_long_parts_are_found_and_masked():
    key = "aB3" * 100
    for text, kind in ((f"user: bob\n{key}==", "key"), (f"account: {'x' * 90}\n{key[:60]}", "ident"), (f"password=abcdefgh1 https://{'h' * 300}/end", "endpoint")):
        spans = [s for s in credentials.find(text) if s[0] == kind]
        assert len(spans) == 1
        assert spans[0][2] == len(text) or kind == "ident" and text[spans[0][2]] == "\n"
    assert key[100:200] not in credentials.masked(f"user: bob\n{key}", credentials.find(f"user: bob\n{key}"))


def test_long_parts_take_no_long():
    text = "user: bob " + "aB3" * 100_000 + " " + " ".join("user: bob " + "aB3" * 8 for _ in range(8_000))
    began = time.process_time()
    assert sum(s[0] == "key" for s in credentials.find(text)) == 8_001
    assert time.process_time() - began < 10
