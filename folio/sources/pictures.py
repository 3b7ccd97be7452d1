"""Sizes of picture files from their headers: PNG, JPEG, GIF and BMP, with the resolution that they state.

``binaryFile`` reads the files from any store; a header is some hundred bytes, so only these are looked at and no picture is decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Dots an inch where a file states none.
DPI = 96.0
#: Fixed values of the format: JPEG frame headers, those of Huffman tables, extensions and arithmetic coding left out.
_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
SCHEMA = "path string, kind string, width int, height int, dpi double, error string"


class Unknown(ValueError):
    """Not a picture of a known kind, or cut off."""


def _png(data: bytes) -> tuple[int, int, float]:
    if data[12:16] != b"IHDR":
        raise Unknown("no header")
    width, height = struct.unpack(">II", data[16:24])
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"pHYs" and size == 9 and at + 17 <= len(data):
            across, _, unit = struct.unpack(">IIB", data[at + 8 : at + 17])
            return width, height, across * 0.0254 if unit == 1 and across else DPI
        if kind in (b"IDAT", b"IEND"):
            break
        at += 12 + size
    return width, height, DPI


def _jpeg(data: bytes) -> tuple[int, int, float]:
    at, dpi = 2, DPI
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Unknown("no marker")
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if kind == 0xE0 and data[at + 4 : at + 9] == b"JFIF\0":
            unit, across = struct.unpack(">BH", data[at + 11 : at + 14])
            dpi = across if unit == 1 and across else across * 2.54 if unit == 2 and across else DPI
        if kind in _FRAMES:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height, float(dpi)
        at += 2 + size
    raise Unknown("no frame")


def _gif(data: bytes) -> tuple[int, int, float]:
    return (*struct.unpack("<HH", data[6:10]), DPI)


def _bmp(data: bytes) -> tuple[int, int, float]:
    width, height = struct.unpack("<ii", data[18:26])
    across = struct.unpack("<i", data[38:42])[0]
    return width, abs(height), across * 0.0254 if across > 0 else DPI


KINDS = ((b"\x89PNG\r\n\x1a\n", "png", _png), (b"\xff\xd8", "jpeg", _jpeg), (b"GIF8", "gif", _gif), (b"BM", "bmp", _bmp))


def header(data: bytes | None) -> tuple[str, int, int, float]:
    """(kind, pixels wide, pixels high, dots an inch)."""
    for magic, kind, read in KINDS:
        if data and data.startswith(magic):
            try:
                width, height, dpi = read(data)
            except struct.error as e:
                raise Unknown("cut off") from e
            if width < 1 or height < 1:
                raise Unknown("no size")
            return kind, width, height, dpi
    raise Unknown("no picture")


def sizes(files: DataFrame) -> DataFrame:
    """path, kind, width, height, dpi, error of rows path, content; a file that can't be read gives one row with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows.append((path, *header(content.as_py()), None))
                except Unknown as e:
                    rows.append((path, None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "kind", "width", "height", "dpi", "error"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)
