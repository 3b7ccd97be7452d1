r"""Secret scans with multipart credential linking.

Base kinds, each leftmost and non-overlapping in itself:

======  ========================================================================================================
assign  ``(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)``, letters of the
        name in either case, value of 8 characters or more
access  ``AKIA[A-Z0-9]+``, 16 characters or more
hex     ``[0-9a-f]+``, 32 characters or more
======  ========================================================================================================

Some parts of a credential mean nothing alone: a 40-character base64 run may be anything. Such weak candidates (``key``:
base64-like runs of 20 characters or more that mix cases and digits; ``ident``: a user, client or account assignment;
``endpoint``: an address of a service) are joined to the other parts by intervals: parts link when they lie within
SCOPE characters of each other in one scope (a stretch of text without an empty line). A ``key`` is reported
only when an identifier (``access`` or ``ident``) and it link; an ``ident`` or ``endpoint`` only as part of such a group or
beside an ``assign``. Added spans never replace base ones.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folio.llm.common import per_row, tidy

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key", "ident", "endpoint")
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: Characters between two parts of one credential at most.
SCOPE = 300
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]++)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"[0-9a-f]{32,}+")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
_IDENT = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?[ ]{0,8}[:=][ ]{0,8}["']?([A-Za-z0-9@._-]{3,}+)""", re.I | re.A)
_ENDPOINT = re.compile(r"\b(?:https?|jdbc:[a-z]{2,20}|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s\"'<>]{3,}+")
_BREAK = re.compile(r"\n[ \t]*+\n")


def base(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds."""
    out = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return out


def _mixed(value: str) -> bool:
    return any("0" <= c <= "9" for c in value) and any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value)


def weak(text: str, strong: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Candidates that are reported only in company; where nothing could keep them company they aren't searched for."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), "ident", m.end()) for m in _IDENT.finditer(text)]
    if out or any(s[1] == "access" for s in strong):
        out += [(m.start(), "key", m.end()) for m in _KEY.finditer(text) if _mixed(m[0])]
    if "://" in text and (out or strong):
        out += [(m.start(), "endpoint", m.end()) for m in _ENDPOINT.finditer(text)]
    return out


def linked(text: str, strong: list[tuple[int, str, int]], candidates: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The candidates that link to complementary parts: a sorted interval join, linear but for the sort.

    A key needs an access identifier or ident near it; an ident or endpoint needs a reported key or an assign near it.
    """
    if not candidates:
        return []
    breaks = [m.start() for m in _BREAK.finditer(text)]
    scope = lambda at: bisect.bisect_right(breaks, at)
    taken = sorted((a, b) for a, _, b in strong)
    ends = list(itertools.accumulate((b for _, b in taken), max))
    starts = [a for a, _ in taken]

    def covered(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        return i > 0 and ends[i - 1] > a

    def near(parts: list[tuple[int, str, int]]) -> object:
        parts = sorted(parts)
        first = [p[0] for p in parts]
        # For each part the two that reach furthest of its scope's parts so far, so a long one costs no walk.
        reach: list[list[tuple[int, str, int]]] = []
        for i, p in enumerate(parts):
            before = reach[-1] if i and scope(first[i - 1]) == scope(p[0]) else []
            reach.append(sorted([*before, p], key=lambda x: -x[2])[:2])

        def test(part: tuple[int, str, int]) -> bool:
            a, _, b = part
            k = scope(a)
            hi = bisect.bisect_right(first, b + SCOPE)
            if k < len(breaks):
                hi = min(hi, bisect.bisect_left(first, breaks[k]))
            return hi > 0 and scope(first[hi - 1]) == k and any(p[2] >= a - SCOPE for p in reach[hi - 1] if p != part)

        return test

    keys = [c for c in candidates if c[1] == "key" and not covered(c[0], c[2])]
    if not keys and not strong:
        return []
    others = [c for c in candidates if c[1] != "key"]
    to_ident = near([s for s in strong if s[1] == "access"] + [c for c in others if c[1] == "ident"])
    # An endpoint's own address is no key.
    spots = sorted((c[0], c[2]) for c in others if c[1] == "endpoint")
    heads = [a for a, _ in spots]
    inside = lambda c: (i := bisect.bisect_right(heads, c[0])) > 0 and spots[i - 1][1] >= c[2]
    keys = [k for k in keys if not inside(k) and to_ident(k)]
    to_secret = near(keys + [s for s in strong if s[1] == "assign"])
    return keys + [c for c in others if to_secret(c)]


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then by kind as in KINDS."""
    if not text:
        return []
    strong = base(text)
    found = strong + linked(text, strong, weak(text, strong))
    return [(k, a, b) for a, k, b in sorted(found, key=lambda s: (s[0], _ORDER[s[1]]))]


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with MASK in place of each stretch that spans cover; an endpoint alone stays."""
    out, at = [], 0
    if text is None:
        return None
    for _, a, b in sorted((s for s in spans if s[0] != "endpoint"), key=lambda s: s[1:]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_linked", T.LongType()),
    ]
)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts of the base kinds, a digest of their spans, all spans, how many were linked.

    Null and empty texts have none; null ids stay null. Whole texts are searched, parts of any length; repeated rows give repeated rows. Spans that
    start together come in the order of KINDS. Other columns are ignored, whatever their names; an empty table gives an empty one.
    No shuffle: a scope never leaves its document, so the interval join is done where the text is.
    """

    def work(ids: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in SCHEMA.fieldNames()}
        for i, value in zip(ids, texts, strict=True):
            spans = find(value)
            kinds = [s[0] for s in spans]
            out["doc_id"].append(i)
            for k in BASE_KINDS:
                out[f"n_{k}"].append(kinds.count(k))
            strong = [s for s in spans if s[0] in BASE_KINDS]
            out["base_sha256"].append(hashlib.sha256(spelled(strong).encode()).hexdigest())
            out["spans"].append(spelled(spans))
            out["n_linked"].append(len(spans) - len(strong))
        return out

    return per_row(docs, doc_id, text, SCHEMA, work)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` masked; all other columns and rows as they are, null texts null, an empty table empty."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [masked(t, find(t)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(clean, b.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)
