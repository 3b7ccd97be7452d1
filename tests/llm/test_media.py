"""PNG round trips, damaged files, and the cosine hash against a plain transform."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000), st.sampled_from([1, 3]))
def test_round_trip(data, channels):
    pixels = np.frombuffer(media.payload_of(data), np.uint8).reshape(-1, media.ROW)
    got, c = media.read_png(media.write_png(pixels, channels))
    assert c == channels
    assert (got == pixels).all()


def plain_filter(kind, x, a, b, c):
    if kind == 4:
        p = a + b - c
        guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
    else:
        guess = (0, a, b, (a + b) // 2)[kind]
    return (x + guess) % 256


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 9), st.integers(1, 7), st.sampled_from([1, 3]))
def test_all_filters_against_a_loop(seed, height, pixels, channels):
    rng = np.random.default_rng(seed)
    kinds = rng.integers(0, 5, height).astype(np.uint8)
    rows = rng.integers(0, 256, (height, pixels * channels), dtype=np.uint8)
    out = [[0] * (pixels * channels) for _ in range(height + 1)]
    for y in range(height):
        for x in range(pixels * channels):
            left = out[y + 1][x - channels] if x >= channels else 0
            corner = out[y][x - channels] if x >= channels else 0
            out[y + 1][x] = plain_filter(int(kinds[y]), int(rows[y, x]), left, out[y][x], corner)
    assert media.unfiltered(kinds, rows, channels).tolist() == out[1:]


@pytest.mark.parametrize("at", [0, 9, 20, 30, 45, -6, -1])
def test_any_flipped_bit_is_noticed(at):
    png = bytearray(media.write_png(np.arange(192 * 4, dtype=np.uint32).astype(np.uint8).reshape(4, 192)))
    png[at] ^= 1
    with pytest.raises(media.BrokenMedia):
        media.read_png(bytes(png))


def test_cut_off_and_foreign_files():
    png = media.write_png(np.zeros((2, 192), np.uint8))
    for bad in (b"", png[:-5], png[:40], b"GIF89a" + png[6:]):
        with pytest.raises(media.BrokenMedia):
            media.read_png(bad)
    deep = bytearray(png)
    deep[24] = 16
    deep[29:33] = struct.pack(">I", zlib.crc32(deep[12:29]))
    with pytest.raises(media.BrokenMedia):
        media.read_png(bytes(deep))


def test_hash_is_the_plain_transform():
    pixels = np.random.default_rng(3).integers(0, 256, (32, 96), dtype=np.uint8)
    grey = pixels.reshape(32, 32, 3).mean(axis=2)
    low = [[sum(grey[y, x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) / 16 * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) for v in range(8)] for u in range(8)]
    flat = np.array(low).ravel()
    assert media.dct_hash(pixels) == np.packbits(flat > np.median(flat[1:])).tobytes()


def test_query_rows(spark):
    rows = [(1, "abc", 9), (2, None, 9), (3, "", 9), (1, "abc", 9), (None, "é" * 5000, 9), (5, "x" * 192, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = media.media_features(media.store_texts(df)).collect()
    assert len(got) == 6
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_bytes"])), sorted(rows, key=lambda r: (r[0] or 0, len((r[1] or "").encode()))), strict=True):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["broken"]) == (i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), None)
    assert media.store_texts(df.limit(0)).count() == 0
    broken = spark.createDataFrame([(1, 3, bytearray(b"x")), (2, 3, None)], "doc_id long, n_bytes long, media binary")
    assert all(r["broken"] and r["payload_sha256"] is None for r in media.media_features(broken).collect())
