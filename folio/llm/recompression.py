"""Exact long repeats by recompression.

A document is a sequence of words. Rounds rename it: first each run of one symbol becomes one symbol, then symbols are split
by a hash of their names into left and right ones, and each left symbol followed by a right one becomes, with it, one
symbol. A name is a hash of what it stands for, so equal names mean equal words everywhere, in all documents and tasks. What becomes of a
symbol depends on a few neighbours only; the stretch of words that it depends on is kept with it (its reach). Two equal
windows of words therefore hold the same symbols, apart from those whose reach leaves the window.

Each window of WINDOW words is filed under one symbol whose reach lies inside it: of the highest level there is, the one with
the least hash. As this choice depends on the window's words alone, equal windows are filed under equal names. So only
windows whose name occurs twice anywhere can repeat. Consecutive windows under one symbol make a cluster; clusters with
equal words are folded together. Where clusters of one name differ, their windows' own words decide.

Symbols' names have 64 bits, and only propose. What decides, words of clusters and of windows, is compared by names of 128 bits that
rest on a cryptographic hash of each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import Spill, checkpoint, chunks, tidy
from folio.llm.hashing import Stretches, Words, mix

U = np.uint64
WINDOW = 35
ROUNDS = 5
#: Bytes of text that are renamed at once, and words of one text; a longer text is renamed in stretches that share WINDOW - 1 words.
BYTES = 1 << 20
SEGMENT = 1 << 18


class Level:
    """Symbols of one level: names, the words they cover, and their reach, all half open."""

    def __init__(self, name, start, end, low, high):
        self.name, self.start, self.end, self.low, self.high = name, start, end, low, high

    @classmethod
    def words(cls, hashes: np.ndarray) -> Level:
        at = np.arange(len(hashes))
        return cls(hashes, at, at + 1, at, at + 1)


def runs(level: Level, words: np.ndarray, number: int) -> Level:
    """Each run of one name becomes one symbol.

    That a run ends depends on its neighbours. If the word next to it already differs from the one the run's symbol would go on with,
    this word is all it depends on, else it is the neighbour's whole reach.
    """
    n = len(level.name)
    new = np.ones(n, bool)
    new[1:] = level.name[1:] != level.name[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    count = (last - first + 1).astype(U)
    name = level.name[first]
    name = np.where(count > U(1), mix(name ^ mix(count + U(1000 + number))), name)
    start, end = level.start[first], level.end[last]
    low, high = level.low[first].copy(), level.high[last].copy()
    total = len(words)
    before, after = np.maximum(start - 1, 0), np.minimum(end, total - 1)
    plain = words[before] != words[level.end[first] - 1]
    reach = np.where(plain, before, level.low[np.maximum(first - 1, 0)])
    low = np.minimum(low, np.where(start > 0, reach, -1))
    plain = words[after] != words[level.start[last]]
    reach = np.where(plain, after + 1, level.high[np.minimum(last + 1, n - 1)])
    high = np.maximum(high, np.where(end < total, reach, total + 1))
    return Level(name, start, end, low, high)


def pairs(level: Level, number: int) -> Level:
    """Each left symbol followed by a right one becomes one symbol with it. Others depend on the neighbour that wasn't their match."""
    n = len(level.name)
    right = (mix(level.name + U(number)) >> U(63)).astype(bool)
    joins = np.zeros(n, bool)
    joins[:-1] = ~right[:-1] & right[1:]
    second = np.zeros(n, bool)
    second[1:] = joins[:-1]
    keep = np.flatnonzero(~second)
    merged = joins[keep]
    mate = np.minimum(keep + 1, n - 1)
    name = np.where(merged, mix(level.name[keep] * U(3) + mix(level.name[mate] + U(2000 + number))), level.name[keep])
    start, end = level.start[keep], np.where(merged, level.end[mate], level.end[keep])
    low, high = level.low[keep].copy(), np.where(merged, np.maximum(level.high[mate], level.high[keep]), level.high[keep])
    low = np.where(merged, np.minimum(low, level.low[mate]), low)
    alone_left, alone_right = ~merged & ~right[keep], ~merged & right[keep]
    edge = level.end[-1] + 1
    after = np.where(keep + 1 < n, level.high[mate], edge)
    high = np.where(alone_left, np.maximum(high, after), high)
    before = np.where(keep > 0, level.low[np.maximum(keep - 1, 0)], -1)
    low = np.where(alone_right, np.minimum(low, before), low)
    return Level(name, start, end, low, high)


def levels(words: np.ndarray) -> list[Level]:
    out = [Level.words(words)]
    for number in range(1, ROUNDS + 1):
        now = pairs(runs(out[-1], words, number), number)
        # Symbols whose reach is longer than a window can't be used, nor anything made of them.
        if not (now.high - now.low <= WINDOW).any():
            break
        out.append(now)
    return out


#: Low bits that hold a symbol's place among those renamed at once, in values whose high bits are its hash; SEGMENT and BYTES keep them fewer.
_PLACE = U((1 << 24) - 1)


def _least_in(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the least hash in each range first..last (inclusive, not empty), the first of equals."""
    now = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=U)
    size = last - first + 1
    power = np.zeros(int(size.max()) + 1, np.int64)
    power[1:] = np.floor(np.log2(np.arange(1, len(power)))).astype(np.int64)
    level = power[size]
    out = np.empty(len(first), U)
    step = 1
    for p in range(int(power[-1]) + 1):
        at = np.flatnonzero(level == p)
        out[at] = np.minimum(now[first[at]], now[last[at] - step + 1])
        now = np.minimum(now[:-step], now[step:]) if len(now) > step else now
        step *= 2
    return (out & _PLACE).astype(np.int64)


def clusters(lanes: tuple[np.ndarray, np.ndarray], limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """The clusters of a batch: name, both halves of the words' name, document, first window, windows, the symbol's offset from it, its reach.

    ``limits``: where each document's words start, and the end. Each window is in one stretch of SEGMENT windows; as names don't
    depend on what lies outside a window, it doesn't matter where stretches end.
    """
    found = []
    first = 0
    while first < len(limits) - 1:
        last = max(first + 1, int(np.searchsorted(limits, limits[first] + SEGMENT, "right")) - 1)
        begin, end = int(limits[first]), int(limits[last])
        if last > first + 1 or end - begin <= SEGMENT:
            found.append(_clusters(lanes, limits[first : last + 1], first, 0))
        else:
            found += [_clusters(lanes, np.array([at, min(end, at + SEGMENT + WINDOW - 1)]), first, at - begin) for at in range(begin, end, SEGMENT)]
        first = last
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, U), none, none, none, none, none
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _clusters(lanes: tuple[np.ndarray, np.ndarray], limits: np.ndarray, doc_from: int, window_from: int) -> tuple[np.ndarray, ...]:
    """Those of the words within ``limits``; documents and windows are numbered from doc_from and window_from."""
    first, second = (lane[limits[0] : limits[-1]] for lane in lanes)
    limits = limits - limits[0]
    room = np.maximum(np.diff(limits) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(room)), room)
    if not len(doc):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, U), none, none, none, none, none
    window = np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + limits[:-1][doc]
    label, low_of, reach = np.zeros(len(doc), U), np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    pending = np.arange(len(doc))
    for number, level in reversed(list(enumerate(levels(first)))):
        # Reaches start and end in the order of their symbols, so a window's candidates are neighbours.
        fits = level.high - level.low <= WINDOW
        if not len(pending) or not fits.any():
            continue
        low, high, name = level.low[fits], level.high[fits], level.name[fits]
        at = window[pending]
        begin, last = np.searchsorted(low, at, "left"), np.searchsorted(high, at + WINDOW, "right") - 1
        has = begin <= last
        if has.any():
            best = _least_in(mix(name + U(77)), begin[has], last[has])
            done = pending[has]
            label[done], low_of[done], reach[done] = mix(name[best] + U(number)), low[best], high[best] - low[best]
            pending = pending[~has]
    new = np.ones(len(doc), bool)
    new[1:] = (label[1:] != label[:-1]) | (low_of[1:] != low_of[:-1]) | (reach[1:] != reach[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(doc)))
    start = window[head]
    offset = low_of[head] - start
    halves = [mix(Stretches(lane).of(start, start + count + WINDOW - 1) + offset.astype(U)) for lane in (first, second)]
    return label[head], *halves, doc[head] + doc_from, start - limits[:-1][doc[head]] + window_from, count, offset, reach[head]


def _packed(start, count, offset, reach):
    """A cluster's place in one number: first window, windows, the symbol's offset and its reach (each of the last three under 256)."""
    return (start << 24) | (count << 16) | (offset << 8) | reach


def _start(place: str) -> Column:
    return F.shiftright(place, 24)


def _count(place: str) -> Column:
    return F.shiftright(place, 16).bitwiseAND(F.lit(255))


def _filed(docs: DataFrame) -> DataFrame:
    """name, words and more (both halves of the words' name), doc, tag, place of every cluster of rows doc, tag, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for part, texts in chunks(rows, b.column(2), BYTES):
                words = Words(texts)
                name, half, other, at, *place = clusters(words.names(), words.limits)
                ids = [np.array(x, np.int64)[at] if len(x) else np.zeros(0, np.int64) for x in zip(*part, strict=True)]
                yield pa.record_batch([*(pa.array(x.astype(np.int64)) for x in (name, half, other)), pa.array(ids[0]), pa.array(ids[1]), pa.array(_packed(*place))], names=["name", "words", "more", "doc", "tag", "place"])

    return docs.mapInArrow(tidy(run), "name long, words long, more long, doc long, tag long, place long")


def _around(joined: DataFrame) -> DataFrame:
    """For each cluster that stands for its group (doc, tag, text, places: array of place and weight): names of its windows, and of
    its symbol with so many words to the left or to the right that equal windows agree in one of both."""

    def one(lanes: list[np.ndarray], limits: np.ndarray, ids: list[np.ndarray], doc: np.ndarray, place: np.ndarray, weight: np.ndarray, skipped: int) -> pa.RecordBatch:
        start = (place >> 24) - skipped + limits[:-1][doc]
        count, offset, reach = (place >> 16) & 255, (place >> 8) & 255, place & 255
        first, second = (Stretches(lane) for lane in lanes)
        low, high = start + offset, start + offset + reach
        left = (WINDOW - reach + 1) // 2
        right = WINDOW - reach - left + 1
        salt = reach.astype(U)
        ok_left, ok_right = low - left >= limits[:-1][doc], high + right <= limits[1:][doc]
        from_left = mix(first.of(np.maximum(low - left, 0), high) + salt).astype(np.int64)
        from_right = mix(first.of(low, np.minimum(high + right, limits[-1])) ^ (salt + U(0x5555))).astype(np.int64)
        ends = np.cumsum(count)
        window = np.repeat(start - ends + count, count) + np.arange(int(ends[-1]))
        halves = [pa.array(s.of(window, window + WINDOW).astype(np.int64)) for s in (first, second)]
        windows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.StructArray.from_arrays(halves, names=["h", "i"]))
        return pa.record_batch([pa.array(ids[0][doc]), pa.array(ids[1][doc]), pa.array(place), pa.array(weight), pa.array(from_left, mask=~ok_left), pa.array(from_right, mask=~ok_right), windows], names=["doc", "tag", "place", "c", "l", "r", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True))
            for part, texts in chunks(rows, b.column(2), BYTES):
                found = Words(texts)
                lanes, limits = found.names(), found.limits
                lists = [p.values for _, _, p in part]
                packed = pa.concat_arrays(lists)
                place, weight = np.asarray(packed.field("place")), np.asarray(packed.field("c"))
                doc = np.repeat(np.arange(len(part)), [len(x) for x in lists])
                ids = [np.array(x, np.int64) for x in list(zip(*part, strict=True))[:2]]
                if len(part) > 1 or limits[-1] <= SEGMENT:
                    yield one(lanes, limits, ids, doc, place, weight, 0)
                    continue
                # One long text: stretch by stretch, each with the words around it that its clusters and windows may need.
                stretch = (place >> 24) // SEGMENT
                for k in np.unique(stretch).tolist():
                    at = stretch == k
                    a, z = max(0, k * SEGMENT - WINDOW), min(int(limits[-1]), (k + 1) * SEGMENT + 256 + 2 * WINDOW)
                    yield one([lane[a:z] for lane in lanes], np.array([0, z - a]), ids, doc[at], place[at], weight[at], a)

    return joined.select("doc", "tag", "text", "places").mapInArrow(tidy(run), "doc long, tag long, place long, c long, l long, r long, windows array<struct<h: long, i: long>>")


def _cut(joined: DataFrame, texts: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept of rows doc_id, text, spans (array of first window and windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(2), strict=True))
            for part, values in chunks(rows, b.column(1), BYTES):
                words = Words(values)
                marks = np.zeros(len(words) + 1, np.int64)
                for (_, spans), first in zip(part, words.limits[:-1].tolist(), strict=True):
                    if spans.values is not None and len(spans.values):
                        start, count = np.asarray(spans.values.field("a")) + first, np.asarray(spans.values.field("n"))
                        np.add.at(marks, start, 1)
                        np.add.at(marks, start + count + WINDOW - 1, -1)
                gone = np.cumsum(marks)[:-1] > 0
                removed = np.concatenate([[0], np.cumsum(gone)])[words.limits]
                kept = words.without(gone)
                arrays = [pa.array([i for i, _ in part], pa.int64()), pa.array(np.diff(words.limits)), pa.array(np.diff(removed)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                if texts:
                    arrays.append(pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()))
                yield pa.record_batch(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(arrays)])

    return joined.select("doc_id", "text", "spans").mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept (the text that is left): a row for each row of ``docs``.

    Words are runs that aren't ASCII white space, unchanged. A word goes if a window of WINDOW consecutive words over it also
    starts anywhere else, in the same document or another; all windows are judged on the input. Null, empty and short
    texts lose nothing, a text of any length is read whole. Rows that repeat are each other's repeats, so all words of both go if they have
    WINDOW or more. Rows without an id, or with one id and different texts, are documents of their own. Ties don't occur: nothing is
    chosen. Extra columns are ignored, whatever their names; an empty table gives an empty one.
    """
    ident, value = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    # A document is named by its id and a hash of its text; without an id by two hashes, so that only equal texts share a name.
    source = docs.select(ident.alias("doc_id"), F.coalesce(ident, F.xxhash64(F.lit(1), value)).alias("doc"), F.xxhash64(F.lit(2), ident.isNull(), value).alias("tag"), value.cast("binary").alias("text"))
    filed = Spill(_filed(source.select("doc", "tag", "text")))
    differ = F.expr("min(words) <> max(words) or min(more) <> max(more)")
    names = Spill(filed.df.groupBy("name").agg(F.count("*").alias("n"), differ.alias("differ")).where("n > 1").select("name", "differ"))
    hits = Spill(filed.df.join(names.df, "name"))
    filed.drop()
    names.drop()
    # All clusters of a name have the same words: each of their windows repeats.
    sure = hits.df.where("not differ").select("doc", "tag", "place")
    differ = hits.df.where("differ")
    groups = Spill(differ.groupBy("name", "words", "more").agg(F.count("*").alias("c"), F.min(F.struct("doc", "tag", "place")).alias("one")))
    equal = differ.join(groups.df.where("c > 1").select("name", "words", "more"), ["name", "words", "more"]).select("doc", "tag", "place")
    # One cluster of each group stands for it, with the group's size as weight.
    wanted = groups.df.select("one.doc", "one.tag", "one.place", "c").groupBy("doc", "tag").agg(F.collect_list(F.struct("place", "c")).alias("places"))
    around = Spill(_around(source.select("doc", "tag", "text").join(wanted, ["doc", "tag"]).dropDuplicates(["doc", "tag"])))
    sides = around.df.select("doc", "tag", "place", F.explode(F.array("l", "r")).alias("side")).where("side is not null")
    shared = sides.groupBy("side").agg(F.count("*").alias("n")).where("n > 1").select("side")
    alike = sides.join(checkpoint(shared), "side", "left_semi").select("doc", "tag", "place").distinct()
    exploded = around.df.join(alike, ["doc", "tag", "place"]).select("doc", "tag", "c", _start("place").alias("a"), F.posexplode("windows").alias("k", "w"))
    windows = Spill(exploded.select("doc", "tag", "c", (F.col("a") + F.col("k")).alias("a"), "w.h", "w.i"))
    twice = checkpoint(windows.df.groupBy("h", "i").agg(F.sum("c").alias("n")).where("n > 1").select("h", "i"))
    single = windows.df.where("c = 1").join(twice, ["h", "i"], "left_semi").select("doc", "tag", "a", F.lit(1).cast("long").alias("n"))
    spans = sure.unionAll(equal).select("doc", "tag", _start("place").alias("a"), _count("place").alias("n")).unionAll(single)
    # Rows that repeat have the same spans, which count once.
    by_doc = checkpoint(spans.groupBy("doc", "tag").agg(F.collect_set(F.struct("a", "n")).alias("spans")))
    for s in (hits, groups, around, windows):
        s.drop()
    return _cut(source.join(by_doc, ["doc", "tag"], "left"), texts)
