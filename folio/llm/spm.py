"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed by hand: pieces with scores and types, trainer and normaliser settings. From it a
``tokenizers`` backend is built: the normaliser (identity or its precompiled map, white space rules, dummy prefix, and the
metaspace marker), and the model, which is Unigram with its scores, or BPE whose merges follow from the scores. Bytes that no piece covers fall back to byte pieces.

A text is cut before each run of markers and around line ends where that provably changes nothing: no piece that merges holds a
marker after another character, or a line end beside one, and neither can be part of a run of unknown characters, which is one unknown. So the backend merges word by word, remembers frequent words in its own
bounded cache, and works on the library's threads. ``parity`` holds the ids against the sentencepiece library; only where two ways to
cut a text have the same score to the last bit may a unigram model's ids differ.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import chunks, tidy

MARK = "▁"
#: Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads of the backend in each process; and bytes of text that it gets at once.
THREADS = "2"
BYTES = 1 << 18


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"wire type {kind}")
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        if at + n > len(data):
            raise ValueError("cut off")
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix_mark: bool = False
    split_pattern: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                out.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
                out.kind = trainer.get(3, UNIGRAM)
                out.byte_fallback = bool(trainer.get(35, 0))
                out.suffix_mark = bool(trainer.get(24, 0))
            elif number == 3:
                norm = dict(fields(value))
                out.charsmap = norm.get(2, b"")
                out.dummy_prefix, out.squeeze, out.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        if out.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {out.kind}")
        if out.suffix_mark or not out.escape:
            raise ValueError("only models whose marker stands before words")
        return out


class Codec:
    def __init__(self, path: str):
        from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers, pre_tokenizers

        with open(path, "rb") as f:
            self.model = m = Model.parse(f.read())
        self.ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN)
        self.bytes_of = None
        usable = {p: i for i, (p, _, t) in enumerate(m.pieces) if t in (NORMAL, USER)}
        if m.kind == BPE:
            if any(t == UNUSED for _, _, t in m.pieces) or not {c for p, _, t in m.pieces if t == NORMAL for c in p} <= usable.keys():
                raise ValueError("only BPE models without unused pieces whose pieces' characters are pieces")
            order = sorted((p for p in usable if m.pieces[usable[p]][2] == NORMAL), key=lambda p: (-m.pieces[usable[p]][1], usable[p]))
            merges = [(p[:k], p[k:]) for p in order for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            backend = models.BPE(vocab=self.ids, merges=merges, unk_token=m.pieces[self.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            # What text can't stand for gets a name with a space, which normalised text never holds, and the least score, so that unknowns cost the same.
            scores = [s for _, s, t in m.pieces if t == NORMAL]
            least, most = min(scores, default=0.0), max([0.0, *scores])
            # A piece that the user defined costs next to nothing, as scores are logarithms of probabilities.
            own = lambda p, s, t: s if t == NORMAL else len(p.encode()) * most - 0.1 if t == USER else least
            backend = models.Unigram([(p if t in (NORMAL, USER) else f"no {i}", own(p, s, t)) for i, (p, s, t) in enumerate(m.pieces)], self.unknown)
            # So are bytes' names, which a text may hold: unknowns become bytes here.
            self.bytes_of = [self.ids[f"<0x{i:02X}>"] for i in range(256)] if m.byte_fallback else None
        self.tokenizer = Tokenizer(backend)
        self.tokenizer.encode_special_tokens = True
        user = [p for p, _, t in m.pieces if t == USER]
        if user and m.kind == BPE:
            self.tokenizer.add_tokens([AddedToken(p, normalized=False) for p in user])
        self.map = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        # The proof that cutting changes nothing: merges only make pieces, none holds such neighbours, and no run of unknowns is cut.
        neighbours = {p[i : i + 2] for p in usable for i in range(len(p) - 1)}
        apart = lambda c: m.byte_fallback or c in usable
        if not (user and m.kind == BPE) and apart(MARK) and not any(n[1] == MARK != n[0] for n in neighbours):
            line = "\n" if apart("\n") and not any("\n" in n for n in neighbours) else ""
            self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + ("|\n" if line else "")), "isolated")
        #: What each id decodes to.
        self.spelled = [bytes([int(p[3:5], 16)]) if t == BYTE else " \u2047 ".encode() if t == UNKNOWN else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, _, t in m.pieces]

    def normalised(self, text: str) -> str:
        if self.map:
            text = self.map.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = ((" " if self.model.dummy_prefix else "") + text).replace(" ", MARK)
        return text.rstrip(MARK) if self.model.squeeze else text

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids without begin and end as packed 32-bit numbers; null and empty texts have none."""
        flat = [self.normalised(t) if t else "" for t in texts]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(flat, add_special_tokens=False)]
        if self.bytes_of is not None:
            found = [self._with_bytes(t) if self.unknown in ids else ids for ids, t in zip(found, flat, strict=True)]
        return [array("i", ids).tobytes() for ids in found]

    def _with_bytes(self, flat: str) -> list[int]:
        """The ids of a normalised text with unknowns, each unknown stretch as its bytes."""
        e = self.tokenizer.encode(flat, add_special_tokens=False)
        return [x for i, text in zip(e.ids, e.tokens, strict=True) for x in ((i,) if i != self.unknown else map(self.bytes_of.__getitem__, text.encode()))]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [array("i", x).tolist() for x in self.packed(texts)]

    def readable(self, text: str | None) -> str:
        """The normalised text as decoding gives it."""
        return self.normalised(text)[self.model.dummy_prefix :].replace(MARK, " ") if text else ""

    def decode(self, ids: Iterable[int]) -> str:
        """The normalised text; bytes that aren't UTF-8 become replacement characters, unknowns the format's own sign."""
        parts = map(self.spelled.__getitem__, ids)
        text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for a process, whatever the tasks that it runs, with few threads of its own, as an executor runs several processes."""
    os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
    return Codec(path)


def parity(path: str, texts: list[str]) -> list[int]:
    """Indexes of the texts whose ids differ from the sentencepiece library's."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)
    return [i for i, (a, b) in enumerate(zip(Codec(path).encode(texts), theirs, strict=True)) if a != b]


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids, and whether decoding gives the normalised text back: one row for each row, whole texts.

    Null and empty texts have an empty list; null ids stay null. Repeated rows give repeated rows; other columns are ignored, whatever their
    names; an empty table gives an empty one. Of cuts with the same score the backend's own first one counts. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1), BYTES):
                got = own.packed(texts)
                back = [own.decode(memoryview(p).cast("i")) == own.readable(t) for p, t in zip(got, texts, strict=True)]
                sizes = [len(p) // 4 for p in got]
                pieces = pa.ListArray.from_arrays(pa.array(list(itertools.accumulate(sizes, initial=0)), pa.int32()), pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(got))]))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pieces, pa.array(back)], names=ENCODED.fieldNames())

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(tidy(run), ENCODED)


DECODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of doc_id, ids; a null list gives a null text, an empty one an empty text, an empty table an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            texts = [None if x is None else own.decode(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), DECODED)
