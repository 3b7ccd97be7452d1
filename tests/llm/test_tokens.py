"""Counts and ids are the libraries' own, on odd texts too."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from folio.llm import spm, token_counts

ODD = ["", "a", "  x  y  ", "a\n\nb\t c", "é▁ ▁▁x", "<s> </s> <unk>", "　全角 テスト 😀😀 \x00 x", "'s 'S I'll   \n\n  x", "<|endoftext|>a<|endoftext|>", " " * 50, "aaa" * 3000, "࢏՚1", "x\x85y\x1cz᠎", "“quotes” — dash…", "\U00010940 new"]
RANDOM = random.Random(1)
TEXTS = ODD + ["".join(RANDOM.choice("ab cdé▁.\n'1<|>日 ́") for _ in range(RANDOM.randrange(60))) for _ in range(400)]


def test_counts_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert token_counts.counter(path).counts([None, *TEXTS]) == [0, *(len(e.ids) for e in library.encode_batch(TEXTS, add_special_tokens=False))]


def test_whole_tokens_are_proven():
    path = public_tokenizers.path("byte_bpe_50k.json")
    c, library = token_counts.counter(path), Tokenizer.from_file(path)
    assert len(c.whole) > 45_000
    some = sorted(c.whole)[::97]
    assert all(len(e.ids) == 1 for e in library.encode_batch(some, add_special_tokens=False))


def test_memo_may_overflow(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    c = token_counts.Counter(path)
    assert c.counts(TEXTS[:40]) == c.counts(TEXTS[:40]) == token_counts.counter(path).counts(TEXTS[:40])


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_pieces_and_text_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert spm.parity(path, TEXTS) == []
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = spm.codec(path)
    for ids in codec.encode(TEXTS):
        assert codec.decode(ids) == library.decode(ids)


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2 if number < 16 else (number << 3 | 2) & 127 | 128, *([] if number < 16 else [number >> 4])]) + bytes([len(value)]) + value
        else:
            key = number << 3
            out += bytes([key] if key < 128 else [key & 127 | 128, key >> 7]) + bytes([value])
    return out


def test_unigram_models(tmp_path):
    """A small hand-made unigram model: the best path by scores, unknowns fused."""
    import struct

    def piece(text, score, kind=1):
        body = text.encode()
        return b"\x0a" + bytes([len(body)]) + body + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0), ("▁ab", -1.0), ("a", -2.0), ("b", -2.0), ("c", -2.5), ("bc", -1.5), ("▁a", -2.2)]
    data = b"".join(b"\x0a" + bytes([len(piece(*p))]) + piece(*p) for p in pieces)
    data += b"\x12" + bytes([2]) + b"\x18\x01"  # trainer: unigram
    norm = b"\x0a\x08identity" + b"\x18\x01\x20\x01\x28\x01"
    data += b"\x1a" + bytes([len(norm)]) + norm
    path = tmp_path / "u.model"
    path.write_bytes(data)
    texts = ["ab", "abc", "abc  ab", "a b c", "", "xab", "abxyc"]
    assert spm.parity(str(path), texts) == []


def test_tables(spark):
    rows = [(1, "Hello world", 1), (2, None, 1), (3, "", 1), (1, "Hello world", 1), (None, "x " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    path = public_tokenizers.path("piece_bpe_32k.model")
    e = spm.encode(df, path)
    got = {(r["doc_id"], r["n_pieces"]): r["round_trip"] for r in e.collect()}
    assert all(got.values())
    assert e.count() == 5
    assert sorted((r["text"] or "") for r in spm.decode(e, path).collect()) == sorted((t or "") for _, t, _ in rows)
    assert spm.encode(df.limit(0), path).count() == 0
    bpe = public_tokenizers.path("byte_bpe_50k.json")
    counts = {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in token_counts.count_tokens(df, bpe).collect()}
    library = Tokenizer.from_file(bpe)
    assert counts == {(i, len((t or "").encode())): len(library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows}
