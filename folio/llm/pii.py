r"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Base kinds, each leftmost and non-overlapping in itself, found for every text:

=====  ==========================================================================  ===================
email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
ip     ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``                                    parts at most 255
card   ``[0-9]([\x20-]?[0-9])+``                                                   13-19 digits, Luhn
phone  ``\+[0-9][\x20().0-9-]+[0-9]``                                              9-15 digits
=====  ==========================================================================  ===================

Added kinds: ``iban`` (confirmed by mod 97 and, where known, the country's length) and ``ssn`` (ddd-dd-dddd, which no checksum guards, so a
context word within WINDOW characters must speak for it).

Offsets are code points, end exclusive. The patterns below match what the table says in linear time: a run that can't
start a match is tried once and not from each of its characters.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folio.llm.common import per_row

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: Characters on either side of a span in which context words count.
WINDOW = 60
#: Scores: a confirmed span starts at the first, one without a checksum at the second; a context word adds the third.
CONFIRMED, PROPOSED, CONTEXT = 0.7, 0.4, 0.25
#: Words that speak for a kind, and words that speak against any.
FOR = {
    "email": ("mail", "email", "e-mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "telefono", "whatsapp"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security"),
}
AGAINST = ("example", "version", "sample", "dummy", "test")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Fixed lengths of account numbers by country, for those that are often met.
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def _octet(part: str) -> bool:
    return int(part) <= 255 if len(part) <= 3 else len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def ips(text: str) -> list[tuple[int, int]]:
    if text.count(".") < 3:
        return []
    return [m.span() for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def ibans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and len(account) == IBAN_LENGTH.get(account[:2], len(account)) and mod97(account):
            out.append(m.span())
    return out


def _near(text: str, start: int, end: int) -> str:
    return f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()


def _has(near: str, words: tuple[str, ...]) -> bool:
    return any(re.search(rf"(?<!\w){re.escape(w)}(?!\w)", near) for w in words)


def score_of(text: str, kind: str, start: int, end: int) -> float:
    near = _near(text, start, end)
    base = PROPOSED if kind in ("phone", "ssn") else CONFIRMED
    return round(min(1.0, max(0.0, base + CONTEXT * _has(near, FOR[kind]) - CONTEXT * _has(near, AGAINST))), 2)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as in KINDS, then by start."""
    if not text:
        return []
    out = [(k, *s) for k, f in (("email", emails), ("ip", ips), ("card", cards), ("phone", phones), ("iban", ibans)) for s in f(text)]
    out += [("ssn", *m.span()) for m in (_SSN.finditer(text) if "-" in text else ()) if _has(_near(text, *m.span()), FOR["ssn"])]
    return out


def spelled(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_iban", T.LongType()),
        T.StructField("n_ssn", T.LongType()),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
    ]
)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts by kind, a digest of the base spans, all spans and a score for each.

    Null and empty texts have no spans. Whole texts are searched, however long; null ids stay null; repeated rows give repeated rows; other
    columns are ignored, whatever their names; an empty table gives an empty one. Spans that start together come by kind. ``scores`` are in the order of ``spans``: CONFIRMED or PROPOSED, moved by context words. A low
    score never drops a base span. No shuffle.
    """

    def work(ids: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in SCHEMA.fieldNames()}
        for i, value in zip(ids, texts, strict=True):
            spans = find(value)
            kinds = [s[0] for s in spans]
            out["doc_id"].append(i)
            for k in KINDS:
                out[f"n_{k}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(spelled([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest())
            out["spans"].append(spelled(spans))
            out["scores"].append([score_of(value, *s) for s in spans])
        return out

    return per_row(docs, doc_id, text, SCHEMA, work)
