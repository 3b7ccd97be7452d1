"""Media columns: PNG pictures in binary columns, and perceptual hashes of them.

A picture is stored as a real PNG: signature, IHDR, IDAT (zlib), IEND, each chunk with its CRC-32. The writer picks for
each row the filter (none, sub or up) with the least sum of absolute residuals; the reader undoes all five filters with
numpy and refuses a file whose signature, chunk checksum, header or data length is wrong.

The hash is taken from the low frequencies of the cosine transform: grey picture -> 32 x 32 by area means -> two-dimensional
DCT-II -> the 8 x 8 lowest frequencies, a bit each for being above the median of all but the constant one.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folio.llm.common import per_row, tidy

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY, RGB = 0, 2
NONE, SUB, UP, AVERAGE, PAETH = range(5)

#: Payload bytes of a picture's row: 64 RGB pixels.
ROW = 192
CHANNELS = 3
ZLIB_LEVEL = 3
IDAT_BYTES = 1 << 16


class BrokenMedia(ValueError):
    """A file that is no valid picture of the supported kind."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(pixels: np.ndarray, channels: int) -> np.ndarray:
    """Rows of bytes -> rows with the filter's byte in front."""
    rows, width = pixels.shape
    options = np.empty((3, rows, width), np.uint8)
    options[0] = pixels
    options[1] = pixels
    options[1, :, channels:] -= pixels[:, :-channels]
    options[2] = pixels
    options[2, 1:] -= pixels[:-1]
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    out = np.empty((rows, width + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = options[best, np.arange(rows)]
    return out


def write_png(pixels: np.ndarray, channels: int = CHANNELS) -> bytes:
    """``pixels``: one row of bytes for each row of the picture, ``channels`` (1 or 3) bytes a pixel."""
    rows, width = pixels.shape
    head = struct.pack(">IIBBBBB", width // channels, rows, 8, RGB if channels == 3 else GREY, 0, 0, 0)
    packed = zlib.compress(filtered(pixels, channels).tobytes(), ZLIB_LEVEL)
    parts = [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *parts, _chunk(b"IEND", b"")])


def unfiltered(kinds: np.ndarray, rows: np.ndarray, channels: int) -> np.ndarray:
    """Undo the five row filters. Without average and Paeth rows this takes a few numpy calls, else one for each diagonal."""
    if kinds.size and kinds.max() > PAETH:
        raise BrokenMedia(f"unknown row filter {kinds.max()}")
    out = rows.copy()
    height, width = rows.shape
    if not np.isin(kinds, (AVERAGE, PAETH)).any():
        sub = np.flatnonzero(kinds == SUB)
        if sub.size:
            shaped = out[sub].reshape(sub.size, width // channels, channels)
            out[sub] = np.add.accumulate(shaped, axis=1, dtype=np.uint8).reshape(sub.size, width)
        first = np.flatnonzero(kinds != UP)
        edges = np.unique(np.concatenate([[0], first, [height]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                out[a:b] = np.add.accumulate(out[a:b], axis=0, dtype=np.uint8)
        return out
    # A pixel needs its left, upper and upper left neighbours: all pixels of one diagonal can be done at once.
    pixels = width // channels
    grid = np.zeros((height + 1, pixels + 1, channels), np.int16)
    raw = rows.reshape(height, pixels, channels).astype(np.int16)
    for d in range(height + pixels - 1):
        y = np.arange(max(0, d - pixels + 1), min(height, d + 1))
        x = d - y
        left, up, corner, kind = grid[y + 1, x], grid[y, x + 1], grid[y, x], kinds[y][:, None]
        p = left + up - corner
        a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.select([kind == SUB, kind == UP, kind == AVERAGE, kind == PAETH], [left, up, (left + up) >> 1, paeth], 0)
        grid[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return grid[1:, 1:].reshape(height, width).astype(np.uint8)


def read_png(data: bytes) -> tuple[np.ndarray, int]:
    """Rows of bytes and the bytes of a pixel; every checksum is tested."""
    if data[:8] != SIGNATURE:
        raise BrokenMedia("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise BrokenMedia("cut off")
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or len(data) < at + 12 + n:
            raise BrokenMedia("cut off")
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise BrokenMedia(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise BrokenMedia("no header or no end")
    width, height, depth, colour, *rest = head
    if depth != 8 or colour not in (GREY, RGB) or any(rest):
        raise BrokenMedia("only 8-bit grey or RGB without interlace")
    channels = 3 if colour == RGB else 1
    try:
        flat = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise BrokenMedia(str(e)) from e
    if len(flat) != height * (width * channels + 1):
        raise BrokenMedia("length of the picture data")
    rows = np.frombuffer(flat, np.uint8).reshape(height, width * channels + 1)
    return unfiltered(rows[:, 0], rows[:, 1:], channels), channels


SIDE, LOW = 32, 8


@functools.cache
def _cosines() -> np.ndarray:
    k, i = np.mgrid[:LOW, :SIDE]
    out = np.sqrt(2 / SIDE) * np.cos(np.pi * (2 * i + 1) * k / (2 * SIDE))
    out[0] /= np.sqrt(2)
    return out


def _low_of(n: int) -> np.ndarray:
    """LOW x n: area means to SIDE values, then the low cosine frequencies. Tables of up to MOST_KEPT columns are kept, 32 MB of them at most."""
    return _kept_low(n) if n <= MOST_KEPT else _make_low(n)


MOST_KEPT = 1024


def _make_low(n: int) -> np.ndarray:
    edges = np.arange(SIDE + 1) * n / SIDE
    cell = np.arange(n)
    share = np.clip(np.minimum(edges[1:, None], cell + 1) - np.maximum(edges[:-1, None], cell), 0, None)
    return _cosines() @ (share / share.sum(axis=1, keepdims=True))


_kept_low = functools.lru_cache(maxsize=512)(_make_low)


def dct_hash(pixels: np.ndarray, channels: int = CHANNELS) -> bytes:
    """Eight bytes, equal for equal pictures and close for pictures that look alike."""
    rows, width = pixels.shape
    grey = pixels.reshape(rows, width // channels, channels).mean(axis=2)
    low = np.round(_low_of(rows) @ grey @ _low_of(width // channels).T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes and spaces up to a positive multiple of ROW; null counts as empty."""
    raw = text or b""
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


MEDIA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("media", T.BinaryType()),
    ]
)


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text, unpadded), media (a PNG in a binary column).

    Every row gives one row, repeated rows as often as they stand. Null and empty texts give a picture of one row of
    spaces. A text of any length is one picture, whole. Other columns of ``docs`` are ignored, whatever their names; an empty table
    gives an empty one; there are no ties. No shuffle; memory follows the longest text.
    """

    def work(ids: list, texts: list) -> dict[str, list]:
        media = [write_png(np.frombuffer(payload_of(t), np.uint8).reshape(-1, ROW)) for t in texts]
        return {"doc_id": ids, "n_bytes": [len(t or b"") for t in texts], "media": media}

    return per_row(docs, doc_id, text, MEDIA, work, binary=True)


FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("dct_hash", T.BinaryType()),
        T.StructField("broken", T.StringType()),
    ]
)


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored pictures back: payload digests, the last 16 payload bytes' CRC-32, and the cosine hash.

    ``media`` has doc_id, n_bytes and media. A null or broken picture gives a row with null digests and the reason in
    ``broken``, which is null for a sound one. Rows that repeat give rows that repeat; an empty table gives an empty one; other columns are ignored.
    """
    import pyarrow as pa

    schema = FEATURES

    def one(png: bytes | None) -> tuple:
        try:
            if png is None:
                raise BrokenMedia("null")
            pixels, channels = read_png(png)
        except BrokenMedia as e:
            return (None, None, None, len(png or b""), None, None, None, str(e))
        payload = pixels.tobytes()
        low = dct_hash(pixels, channels)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), low.hex(), low, None)

    def run(batches):
        for batch in batches:
            got = [one(png.as_py()) for png in batch.column(2)]
            columns = [list(c) for c in zip(*got, strict=True)] if got else [[] for _ in range(8)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), *arrays], names=schema.fieldNames())

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), schema)
