"""Names of words and of word sequences, over whole batches of documents.

A word's name is 128 bits of a cryptographic hash of its bytes, taken once for each distinct word of a batch. A
stretch of words is named through a tree: stretches of 1, 2, 4, ... words are named by mixing the names of their halves, and any other
length by the two longest of these that cover it. Nothing in it is linear, so no pattern of letters or words makes names collide.
The halves of a name (lanes) never meet on the way, so both together hold as 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Distinct words that are Python objects at a time.
AT_ONCE = 1 << 16
_ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A name for each pair of names, in this order."""
    return mix(x * _ODD + ((y << U(32)) | (y >> U(32))))


class Stretches:
    """Names of all stretches of a sequence of 64-bit names, one lane."""

    def __init__(self, names: np.ndarray):
        self.levels = [mix(names + U(1))]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(joined(half[:-step], half[step:]))
        return self.levels[k]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of start..end (end exclusive, none empty)."""
        size = end - start
        out = np.empty(len(start), U)
        if not len(start):
            return out
        power = np.frexp(size)[1] - 1
        for k in range(int(power.min()), int(power.max()) + 1):
            at = slice(None) if power.min() == power.max() else np.flatnonzero(power == k)
            a, z = start[at], end[at]
            if len(a):
                level = self._level(k)
                out[at] = joined(level[a], level[z - (1 << k)] + (z - a).astype(U))
        return out


class Words:
    """All words of some texts, in order.

    Words are runs of bytes that aren't ASCII white space; ``lower`` folds A-Z first. ``limits`` has where each text's words start, and
    the end; ``start`` and ``end`` are byte positions in ``data``, where one line feed follows each text.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        data = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]), np.uint8)
        self.data = _LOWER[data] if lower else data
        space = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[::2], edge[1::2]
        self._solid = ~space
        self.limits = np.searchsorted(self.start, np.cumsum([0, *[len(t or b"") + 1 for t in texts]]))

    def __len__(self) -> int:
        return len(self.start)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Both lanes of all words' names."""
        if not len(self):
            return np.zeros(0, U), np.zeros(0, U)
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)])
        solid = pa.py_buffer(self.data[self._solid].tobytes())
        words = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets.astype(np.int64)), solid]).dictionary_encode()
        known = b"".join(hashlib.blake2b(w, digest_size=16).digest() for k in range(0, len(words.dictionary), AT_ONCE) for w in words.dictionary.slice(k, AT_ONCE).to_pylist())
        lanes = np.frombuffer(known, "<u8").reshape(-1, 2).astype(U)
        at = words.indices.to_numpy()
        return lanes[at, 0], lanes[at, 1]

    def without(self, gone: np.ndarray) -> list[bytes]:
        """Each text's words that aren't gone, joined by one space."""
        kept = np.flatnonzero(~gone)
        marks = np.zeros(len(self.data) + 2, np.int8)
        marks[self.start[kept]] += 1
        marks[self.end[kept] + 1] -= 1
        data = self.data.copy()
        data[self.end[kept]] = 32
        flat = data[np.cumsum(marks, dtype=np.int8)[: len(data)].astype(bool)].tobytes()
        size = np.concatenate([[0], np.cumsum(self.end[kept] - self.start[kept] + 1)])
        cut = size[np.searchsorted(kept, self.limits)].tolist()
        return [flat[a : max(a, z - 1)] for a, z in zip(cut[:-1], cut[1:], strict=True)]


def word_hashes(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The first lane of all words' names, and where each text's words start (one more entry than texts)."""
    words = Words(texts, lower)
    return words.names()[0], words.limits
