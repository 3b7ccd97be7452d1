r"""Token counts of byte-level BPE by whole-token shortcut.

The tokenizer first cuts a text into pre-tokens by a pattern and then merges bytes inside each. Offline, once in each
process, every string of the vocabulary is encoded alone: those that come out as one token are proven, and a pre-token equal to
one of them counts 1 without any merging. Only the others go through the library's merges, each distinct one once while
it stays in a bounded memo.

The cutting pattern is run by the ``regex`` library, whose Unicode tables are newer than the tokenizer's. So each character is
proven, too, when it is first met: both cutters must agree on it in all contexts that the pattern tells apart. A
text with a character on which they differ is handed to the library whole. Special strings that a text holds are one
token each, as the library's default has it.
"""

from __future__ import annotations

import functools
import json
import os

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import per_row

#: The pattern of byte-level BPE, a fixed value that must equal the tokenizer's.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose counts a process remembers; the memo starts anew beyond that.
MEMO = 400_000
#: Threads of the library in each process, as an executor runs several.
THREADS = "2"
#: Longer pre-tokens aren't remembered.
MEMO_CHARS = 64
LIMIT = 1024


class Counter:
    """Counts tokens as ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError("only byte-level BPE without normaliser and prefix space")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("only plain added tokens")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.cut = regex.compile(PATTERN)
        self.whole = self._prove(spec["model"]["vocab"])
        self.memo: dict[str, int] = {}
        self.sound: set[str] = set()
        self.unsound: set[str] = set()

    def _prove(self, vocab: dict[str, int]) -> dict[str, int]:
        """The vocabulary's strings that are one pre-token and encode alone as one token."""
        decoder = self.tokenizer.decoder
        strings = [s for s in (decoder.decode([t]) for t in vocab) if s and "�" not in s]
        out = {}
        for start in range(0, len(strings), 10_000):
            part = strings[start : start + 10_000]
            for s, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                if len(e.ids) == 1 and self.cut.fullmatch(s) and len(self.cut.findall(s)) == 1:
                    out[s] = 1
        return out

    def _cutters_agree(self, c: str) -> bool:
        probe = f"a{c}1{c}.{c} {c}{c}a {c}1"
        return [s for _, s in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)] == [m.span() for m in self.cut.finditer(probe)]

    def _plain(self, chars: set[str]) -> bool:
        for c in chars - self.sound:
            if c in self.unsound or not self._cutters_agree(c):
                self.unsound.add(c)
                return False
            self.sound.add(c)
        return True

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        rest: set[str] = set()
        whole, memo = self.whole, self.memo
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self._plain(set(text)):
                out[i] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                out[i] = len(parts) - 1
            pieces = [p for part in parts for p in self.cut.findall(part)]
            cut.append((i, pieces))
            rest.update(pieces)
        rest -= whole.keys()
        rest -= memo.keys()
        short = [p for p in rest if len(p) <= MEMO_CHARS]
        long = {p: len(self.tokenizer.encode(p, add_special_tokens=False).ids) for p in rest if len(p) > MEMO_CHARS}
        if len(memo) + len(short) > MEMO:
            memo.clear()
            short = list({p for _, pieces in cut for p in pieces if len(p) <= MEMO_CHARS} - whole.keys())
        for start in range(0, len(short), 20_000):
            part = short[start : start + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                memo[p] = len(e.ids)
        for i, pieces in cut:
            out[i] += sum(1 if p in whole else memo[p] if p in memo else long[p] for p in pieces)
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for a process, whatever the tasks that it runs; so the proof is made once in it."""
    os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
    return Counter(path)


SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_tokens")])


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens: one row for each row of ``docs``, whole texts, no shuffle.

    ``path`` is the tokenizer's file, found on each executor. Null and empty texts have 0 tokens; null ids stay null; repeated rows give
    repeated rows; other columns are ignored, whatever their names; an empty table gives an empty one. There are no ties: merges have ranks.
    """

    def setup():
        own = counter(path)
        return lambda ids, texts: {"doc_id": ids, "n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": own.counts(texts)}

    return per_row(docs, doc_id, text, SCHEMA, None, setup)


def over_limit(n_tokens: str = "n_tokens", limit: int = LIMIT) -> Column:
    return F.col(n_tokens) > limit
