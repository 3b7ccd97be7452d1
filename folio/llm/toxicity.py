"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

Kernel. Two strings are as alike as their common subsequences of ORDERS characters, each weighted by DECAY to the stretch that it
spans in both and with GAPS skipped characters at most, so that gaps and inserted characters cost a little and never all. Strings
are framed by marks, and kernels are divided by what the lengths of both strings allow.

Learning. A document is a set of sentences, a sentence a set of units (its words, with letters that stand apart joined and
signs inside words dropped), and a sentence of a toxic document may hold a toxic unit. Units are counted over the distinct labelled
sentences of training documents, so that copies have one vote; those met in toxic ones far beyond chance are positive, units of clean
sentences are negative. In rounds, rarer units that the machine takes for toxic and that clean sentences lack join the positive
ones, and clean units that it takes for toxic the negative ones. Landmarks span a Nystroem space in which a linear machine is trained by
Newton steps on the squared hinge loss. A document's evidence is its two largest unit decisions, how often units beyond HIT occur, and by
how many toxic sentences the best known of these was learned; a logistic curve, fitted on the training documents, turns it into a score.

Scoring. A machine in the Nystroem space is a weighted sum of kernels with the landmarks, and each kernel is an inner product over
subsequences, so the decision is a sum over the unit's own subsequences of weights that are tabulated once (exactly the same value).
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import checkpoint, chunks, per_row, tidy

ORDERS = (3, 4)
DECAY, GAPS = 0.5, 3
#: A score from which a document counts as toxic.
CUT = 0.7
#: Labelled documents, by a hash of their ids, from which the machine learns at most; of their units it learns from so many positive and
#: negative ones at most, the most frequent first; and landmarks.
MOST_DOCS, MOST_POSITIVE, MOST_NEGATIVE, LANDMARKS = 20_000, 3_000, 150_000, 400
#: Toxic sentences that a positive unit is met in, the share of its sentences that must be toxic, and how unlikely that must be by chance.
LEAST, LEAST_SHARE, CHANCE = 4, 0.8, 1e-6
ROUNDS, HARD = 5, 2_000
#: Toxic sentences from which a unit counts as well known. Such ones are also learned with a character put in, and lend their support to
#: units whose kernel with them is ALIKE or more; so many of them do at most.
WELL_KNOWN, ALIKE, MARKS = 20, 0.5, 200
#: Longest unit; longer words are read in windows that overlap by half. Units whose decisions, or whose support by marks, a process remembers.
LONGEST, MEMO = 24, 250_000
#: Symbols: 0 is the mark of both ends, 1-26 are letters, the others are shared by all other characters.
ALPHABET = 40
#: Where sentences end.
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+|\n")
#: Characters that stand for letters inside words with letters.
STANDINS = str.maketrans("0134578@$!", "oieastbasi")
_SIGNS = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STANDING_IN = re.compile(r"[0134578@$!]")


def units_of_word(word: str) -> tuple[str, ...]:
    """The units of one lower-case word: signs dropped, stand-ins read as letters, long ones in windows."""
    if not word.isalpha():
        if _STANDING_IN.search(word) and any(c.isalpha() for c in word):
            word = word.rstrip("!").translate(STANDINS)
        word = _SIGNS.sub("", word)
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    if len(word) <= LONGEST:
        return (word,) if len(word) > 1 else ()
    step = LONGEST // 2
    return tuple(word[i : i + LONGEST] for i in range(0, len(word) - step, step))


def words_of(text: str | None) -> list[str]:
    """The lower-case words of a whole text; letters that stand apart one by one ("i d i o t") are joined and come last."""
    if not text:
        return []
    text = text.lower()
    found = _WORD.findall(text)
    if _SPELLED.search(text):
        found += [_SIGNS.sub("", m[0]) for m in _SPELLED.finditer(text)]
    return found


def units(text: str | None) -> set[str]:
    """Distinct units of a whole text."""
    return {u for w in set(words_of(text)) for u in units_of_word(w)}


#: Four or more single letters in a row, signs and spaces between them.
_SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][\s.,*_-]{1,2}){3,}[^\W\d_](?![^\W\d_])")


def _flat(units_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all units in a row, marks at both ends of each, and how many each has."""
    cut = [u[:LONGEST] for u in units_]
    sizes = np.array([len(u) for u in cut], np.int64)
    at = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letters = np.where((at >= 97) & (at <= 122), at - 96, 27 + at * 2654435761 % (1 << 32) % (ALPHABET - 27))
    ends = np.cumsum(sizes + 2)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    place = np.ones(len(out), bool)
    place[ends - 1] = place[ends - sizes - 2] = False
    out[place] = letters
    return out, sizes + 2


def coded(units_: list[str]) -> list[np.ndarray]:
    """Symbols of each unit, marks at both ends."""
    symbols, sizes = _flat(units_)
    return np.split(symbols, np.cumsum(sizes)[:-1]) if len(sizes) else []


@functools.cache
def _places(n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All increasing index tuples in n characters with GAPS skipped ones at most, and DECAY to the stretch each spans.

    The weights are divided by their norm, which is what the kernel of a string without repeats with itself would be.
    """
    inner = [t for t in itertools.combinations(range(order + GAPS), order) if t[0] == 0]
    at = np.array([tuple(i + k for k in t) for i in range(n) for t in inner if i + t[-1] < n], np.int64).reshape(-1, order)
    weight = DECAY ** (at[:, -1] - at[:, 0] + 1.0)
    return at, weight / (np.sqrt((weight * weight).sum()) or 1.0)


def _features(batch: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of the subsequences of strings of one length: rows x places, places."""
    at, weight = _places(batch.shape[1], order)
    code = np.zeros((len(batch), len(at)), np.int64)
    for k in range(order):
        code = code * ALPHABET + batch[:, at[:, k]]
    return code, weight


def _by_length(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indexes of strings of one length, a bounded number at a time."""
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        step = max(1, 1_000_000 // max(1, 20 * n))
        yield from (at[i : i + step] for i in range(0, len(at), step))


def explicit(strings: list[np.ndarray]) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The strings' places in the space of the kernel: for each order (codes, values)."""
    out = []
    for s in strings:
        pairs = {}
        for order in ORDERS:
            code, weight = _features(s[None, :], order)
            keys, inverse = np.unique(code[0], return_inverse=True)
            pairs[order] = (keys, np.bincount(inverse, weights=weight, minlength=len(keys)))
        out.append(pairs)
    return out


@dataclass
class Machine:
    """Tables of subsequence weights, the constant, the curve from evidence to scores, and how well positive units are known.

    ``support`` is what training learned and stays as it is; ``lent`` is a bounded memo of what other units got from the marks.
    """

    tables: dict[int, np.ndarray]
    bias: float
    curve: np.ndarray = field(default_factory=lambda: np.array([4.0, 0.0, 0.0, 0.0, 0.0]))
    support: dict[str, float] = field(default_factory=dict)
    marks: list[tuple[str, float]] = field(default_factory=list)
    lent: dict[str, float] = field(default_factory=dict)

    def supported(self, unit: str) -> float:
        """What the unit was learned by, or else what the well known unit most like it was, times the kernel of both."""
        if unit in self.support or not self.marks:
            return self.support.get(unit, 0.0)
        if unit not in self.lent:
            if not hasattr(self, "_rows"):
                self._rows = explicit(coded([m for m, _ in self.marks]))
            kernels = _gram(explicit(coded([unit])), self._rows)[0] / len(ORDERS)
            if len(self.lent) >= MEMO:
                self.lent.clear()
            self.lent[unit] = max(float(k) * s if k >= ALIKE else 0.0 for k, (_, s) in zip(kernels, self.marks, strict=True))
        return self.lent[unit]

    def decide(self, units_: list[str]) -> np.ndarray:
        symbols, sizes = _flat(units_)
        starts = np.cumsum(sizes) - sizes
        out = np.empty(len(sizes))
        for at in _by_length(sizes):
            batch = symbols[starts[at][:, None] + np.arange(sizes[at[0]])]
            value = np.full(len(at), self.bias)
            for order, table in self.tables.items():
                code, weight = _features(batch, order)
                value += table[code] @ weight
            out[at] = value
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve[:-1] + self.curve[-1], -30, 30)))


#: Weight of the curve's penalty on large weights.
HELD_BACK = 0.01
#: Decision of a text without units, and the one from which a unit counts as a hit.
NOTHING, HIT = -2.0, -0.1


class Scorer:
    """Scores texts with a bounded memo of unit decisions. 

    Evidence: the two largest decisions, the logarithm of one more than the hits, and the largest support of a hit.
    """

    def __init__(self, machine: Machine):
        self.machine = machine
        self.unit: dict[str, str] = {}
        self.memo: dict[str, float] = {"": NOTHING}

    def _learn(self, words: set[str]) -> None:
        """Looks up what isn't known of some words. A long word stands for its units, of which the best is its own."""
        new = words - self.unit.keys()
        if len(self.unit) + len(new) > MEMO:
            # What is used now stays, so frequent words do.
            self.unit = {w: self.unit[w] for w in words - new}
            self.memo = {u: self.memo[u] for u in {*self.unit.values(), ""}}
        found = {w: units_of_word(w) for w in new}
        pending = list({u for us in found.values() for u in us} - self.memo.keys())
        self.memo.update(zip(pending, self.machine.decide(pending).tolist(), strict=True))
        self.unit.update((w, max(us, key=self.memo.__getitem__) if us else "") for w, us in found.items())

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        every = [words_of(t) for t in texts]
        self._learn(set().union(*every))
        unit, memo = self.unit, self.memo
        out = np.zeros((len(texts), 4))
        out[:, :2] = NOTHING
        for i, words in enumerate(every):
            own = set(map(unit.__getitem__, words))
            if not own:
                continue
            values = list(map(memo.__getitem__, own))
            out[i, 0] = best = max(values)
            if len(values) > 1:
                values.remove(best)
                out[i, 1] = max(values)
            if best > HIT:
                hits = {u for u in own if memo[u] > HIT}
                out[i, 2] = math.log1p(sum(map(hits.__contains__, map(unit.__getitem__, words))))
                out[i, 3] = max(map(self.machine.supported, hits))
        np.clip(out[:, :2], NOTHING, -NOTHING, out=out[:, :2])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.machine.score(self.evidence(texts))


def varied(words: list[str]) -> list[str]:
    """The words with one character put in, or one of their own doubled, inside."""
    out = []
    for k, w in enumerate(words[:MARKS]):
        for i in range(1, len(w)):
            out.append(w[:i] + "xyzqjkvw"[(k + i) % 8] + w[i:])
            out.append(w[:i] + w[i - 1] + w[i:])
    return [w for w in out if len(w) <= LONGEST]


#: Strings of the second list that a kernel table is made for at once.
COLUMNS = 64


def _gram(a: list[dict], b: list[dict]) -> np.ndarray:
    """Kernels between two lists of strings, over the subsequences that the second list has, a few of its strings at a time."""
    out = np.zeros((len(a), len(b)))
    for order, start in itertools.product(ORDERS, range(0, len(b), COLUMNS)):
        part = b[start : start + COLUMNS]
        known = np.unique(np.concatenate([x[order][0] for x in part]))
        table = np.zeros((len(known) + 1, len(part)))
        for j, x in enumerate(part):
            keys, values = x[order]
            table[np.searchsorted(known, keys), j] = values
        for i, x in enumerate(a):
            keys, values = x[order]
            at = np.searchsorted(known, keys)
            hit = known[np.minimum(at, len(known) - 1)] == keys
            if hit.any():
                out[i, start : start + COLUMNS] += values[hit] @ table[at[hit]]
    return out


def _expansion(positive: list[str], negative: list[str]) -> tuple[list[dict], np.ndarray, float]:
    """A linear machine in the Nystroem space of landmarks from both sides: the landmarks, their weights and the constant."""
    strings = positive + negative
    rows = explicit(coded(strings))
    half = LANDMARKS // 2
    pick = lambda n, most: np.unique(np.linspace(0, n - 1, min(n, most)).astype(int)) if n else np.zeros(0, int)
    marks = np.concatenate([pick(len(positive), half), len(positive) + pick(len(negative), LANDMARKS - half)])
    landmarks = [rows[i] for i in marks]
    kmm = _gram(landmarks, landmarks)
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
    ok = values > 1e-6 * values.max()
    root = vectors[:, ok] / np.sqrt(values[ok])
    x = np.hstack([_gram(rows, landmarks) @ root, np.ones((len(rows), 1))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    cost = np.where(y > 0, 1.0 / max(1, len(positive)), 1.0 / max(1, len(negative))) * len(y) / 2
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-1)
    ridge[-1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        xa = x[active] * cost[active, None]
        new = np.linalg.solve(np.diag(ridge) + xa.T @ x[active], xa.T @ y[active])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return landmarks, root @ w[:-1], float(w[-1])


def train_machine(positive: list[str], negative: list[str]) -> Machine:
    """The machine of the expansion, its sum of kernels tabulated by subsequences."""
    landmarks, beta, bias = _expansion(positive, negative)
    tables = {o: np.zeros(ALPHABET**o, np.float32) for o in ORDERS}
    for b, mark in zip(beta, landmarks, strict=True):
        for o, (keys, v) in mark.items():
            tables[o][keys] += b * v
    return Machine(tables, bias)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and constant of the curve from evidence to labels, slightly held back, by Newton steps. No evidence counts against a label."""
    used = np.ones(x.shape[1], bool)
    while True:
        z = np.hstack([x[:, used], np.ones((len(x), 1))])
        ridge = np.diag([HELD_BACK] * int(used.sum()) + [1e-6])
        w = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            r = p * (1 - p) + 1e-9
            step = np.linalg.solve((z * r[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        if (w[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[np.append(np.flatnonzero(used), x.shape[1])] = w
            return out
        used[np.flatnonzero(used)[int(w[:-1].argmin())]] = False


def _by_chance(t: int, n: int, base: float) -> float:
    """Probability that t or more of n sentences are toxic if each is with probability ``base``; summed from logarithms, so for any n."""
    if t <= 0 or not 0 < base < 1:
        return float(t <= 0 or base >= 1)
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(base) + (n - k) * math.log1p(-base)
    return min(1.0, sum(math.exp(log(k)) for k in range(t, n + 1)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id's digits is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Learns from labelled rows that aren't held out, MOST_DOCS at most, the first by a hash of their ids.

    Null labels and ids are left out; of several labels of one id the largest counts, of several texts the one with the least hash. Whole
    texts are read; equal sentences count once. Without toxic or without clean rows, as in empty tables, the machine scores every text as
    clean. Extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    marked = labels.where(~held_out(doc_id)).where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").cast("long").alias("_id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("_toxic"))
    # Bounded by MOST_DOCS rows of two numbers, so it can be broadcast.
    chosen = checkpoint(marked.orderBy(F.xxhash64("_id"), "_id").limit(MOST_DOCS))
    found = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_id")
    own = checkpoint(found.groupBy("_id", "_toxic").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("m")).select("_toxic", "m._text"))

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for labels_, texts in chunks(b.column(0).to_pylist(), b.column(1)):
                for y, t in zip(labels_, texts, strict=True):
                    cut = sorted(set(_SENTENCE.split(t))) if t else []
                    if cut:
                        yield pa.record_batch([pa.array(cut), pa.array([y] * len(cut), pa.int64())], names=["sentence", "toxic"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(u, y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for u in sorted(units(t))]
            yield pa.record_batch([pa.array([u for u, _ in found], pa.string()), pa.array([y for _, y in found], pa.int64())], names=["unit", "toxic"])

    cut = checkpoint(own.select(F.col("_toxic").cast("long"), "_text").mapInArrow(tidy(sentences), "sentence string, toxic long").groupBy("sentence").agg(F.min("toxic").alias("toxic")))
    counted = checkpoint(cut.mapInArrow(tidy(words), "unit string, toxic long").groupBy("unit").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")))
    base = cut.agg(F.avg("toxic")).first()[0] or 0.0
    often = counted.where((F.col("t") >= LEAST) & (F.col("t") >= LEAST_SHARE * F.col("n"))).orderBy(F.desc("t"), "unit").limit(MOST_POSITIVE).collect()
    positive = sorted({r["unit"] for r in often if _by_chance(r["t"], r["n"], base) < CHANCE})
    rare = counted.where("t = n and n >= 2").orderBy(F.desc("n"), F.xxhash64("unit"), "unit").limit(MOST_NEGATIVE).select("unit").toArrow()["unit"].to_pylist()
    pool = sorted(counted.where("t * 3 < n").orderBy(F.desc("n"), F.xxhash64("unit"), "unit").limit(MOST_NEGATIVE).select("unit").toArrow()["unit"].to_pylist())
    if not positive or not pool:
        return Machine({o: np.zeros(ALPHABET**o, np.float32) for o in ORDERS}, NOTHING)
    negative = pool[:: max(1, len(pool) // HARD)]
    for _ in range(ROUNDS):
        machine = train_machine(positive, negative)
        value = machine.decide(pool)
        order = np.argsort(-value, kind="stable")[:HARD]
        hard = {pool[i] for i in order if value[i] > -0.8}
        liked = {u for u, v in zip(rare, machine.decide(rare), strict=True) if v > 0.5} if rare else set()
        if hard <= set(negative) and liked <= set(positive):
            break
        negative = sorted(set(negative) | hard)
        positive = sorted(set(positive) | set(sorted(liked)[:MOST_POSITIVE]))
    machine = train_machine(sorted(set(positive) | set(varied([r["unit"] for r in often if r["t"] >= WELL_KNOWN and r["unit"] in set(positive)]))), negative)
    known = counted.where("t >= 2 and t * 3 >= n * 2").orderBy(F.desc("t"), "unit").limit(MOST_NEGATIVE).toArrow()
    machine.marks = [(r["unit"], math.log1p(r["t"])) for r in often if r["t"] >= WELL_KNOWN and r["t"] == r["n"]][:MARKS]
    machine.support = {u: math.log1p(t) * max(0.0, 1 - 3 * (n - t) / n) for u, t, n in zip(*(known[c].to_pylist() for c in ("unit", "t", "n")), strict=True)}
    shared = spark.sparkContext.broadcast(machine)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for labels_, texts in chunks(b.column(0).to_pylist(), b.column(1)):
                yield pa.record_batch([pa.array(labels_, pa.int64()), pa.array(scorer.evidence(texts).tolist(), pa.list_(pa.float64()))], names=["toxic", "evidence"])

    seen = own.select(F.col("_toxic").cast("long"), "_text").mapInArrow(tidy(evidence), "toxic long, evidence array<double>").toArrow()
    y, x = np.array(seen["toxic"].to_pylist(), float), np.array(seen["evidence"].to_pylist(), float).reshape(-1, 4)
    if 0 < y.sum() < len(y):
        machine.curve = _logistic(x, y)
    return machine


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType())])


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, evidence: a row for each row of ``docs``, whole texts, no shuffle.

    Null and empty texts have the least evidence. A score depends on its text and the machine only, so equal texts and rows that repeat
    score alike. Extra columns are ignored, whatever their names; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def setup():
        scorer = Scorer(shared.value)

        def work(ids: list, texts: list) -> dict[str, list]:
            found = scorer.evidence(texts)
            return {"doc_id": ids, "evidence": found[:, 0], "score": scorer.machine.score(found)}

        return work

    return per_row(docs, doc_id, text, SCORES, None, setup)


def clean(docs: DataFrame, machine: Machine, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score under ``cut``, columns as they are. Batches are scored by parts, so memory follows the longest text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            scores = [s for _, texts in chunks(list(range(b.num_rows)), b.column(at)) for s in scorer.scores(texts).tolist()]
            yield b.filter(pa.array([s < cut for s in scores], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
