"""Headers of picture files made here."""

from __future__ import annotations

import struct
import zlib

import pytest

from folio.sources import pictures


def png(width, height, per_metre=None):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    phys = chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)) if per_metre else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + phys + chunk(b"IDAT", b"x")


def jpeg(width, height, unit=1, density=300, frame=0xC2):
    jfif = b"JFIF\0\1\1" + struct.pack(">BHH", unit, density, density) + b"\0\0"
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + part(0xE0, jfif) + part(0xC4, b"\0" * 20) + b"\xff" + part(frame, struct.pack(">BHHB", 8, height, width, 3) + b"\0" * 9)


CASES = [
    (png(40, 30), ("png", 40, 30, 96.0)),
    (png(40, 30, 11811), ("png", 40, 30, pytest.approx(300, abs=0.1))),
    (jpeg(640, 480), ("jpeg", 640, 480, 300.0)),
    (jpeg(640, 480, 2, 100), ("jpeg", 640, 480, 254.0)),
    (jpeg(640, 480, 0, 1), ("jpeg", 640, 480, 96.0)),
    (b"GIF89a" + struct.pack("<HH", 7, 9), ("gif", 7, 9, 96.0)),
    (b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6) + b"\0" * 12 + struct.pack("<i", 0), ("bmp", 5, 6, 96.0)),
]


@pytest.mark.parametrize(("data", "expected"), CASES)
def test_headers(data, expected):
    assert pictures.header(data) == expected


@pytest.mark.parametrize("data", [None, b"", b"text", b"\x89PNG\r\n\x1a\n", png(0, 3), b"\xff\xd8\xff\xe0", b"GIF89a\0", jpeg(0, 5)])
def test_others_are_refused(data):
    with pytest.raises(pictures.Unknown):
        pictures.header(data)


def test_relation(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 4))
    (tmp_path / "b.png").write_bytes(b"no")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in pictures.sizes(files).collect()}
    assert got == {"a.png": ("png", 3, 4, 96.0, None), "b.png": (None, None, None, None, "no picture")}
