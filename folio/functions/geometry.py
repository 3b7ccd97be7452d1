"""Numbers with units, colours, rectangles, matrices and the piecewise map of an edited page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Office units. 20 twips, 12,700 EMU and two half-points are a point; 360,000 EMU are a centimetre.
TWIPS_PER_POINT, EMU_PER_POINT, EMU_PER_CM, EMU_PER_TWIP = 20, 12_700, 360_000, 635


def emu_to_cm(emu: Column) -> Column:
    return emu / EMU_PER_CM


def points_to_twips(points: Column) -> Column:
    """Half to even, as the file format's writers round."""
    return F.bround(points * TWIPS_PER_POINT, 0).cast("bigint")


def points_to_halves(points: Column) -> Column:
    return F.bround(points * 2, 0).cast("bigint")


def colour_parts(value: Column) -> Column:
    """A 24-bit colour as three shares of one."""
    part = lambda shift: (F.shiftright(value, shift).bitwiseAND(F.lit(255)) / 255.0)
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def hex_colour(text: Column) -> Column:
    """A 24-bit number of six hexadecimal digits, a leading # allowed; null for anything else."""
    bare = F.upper(F.regexp_replace(text, r"^#", ""))
    return F.when(bare.rlike("^[0-9A-F]{6}$"), F.conv(bare, 16, 10).cast("bigint"))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two rectangles (x0, y0, x1, y1) share."""
    return area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def intersects(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether the interiors meet; touching edges don't."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def valid_rectangle(x0: Column, y0: Column, x1: Column, y1: Column, width: float, height: float) -> Column:
    """Finite, not empty, inside the page."""
    # NaN compares as the largest value and infinities as what they are, so the bounds leave finite numbers only.
    return F.coalesce((x0 < x1) & (y0 < y1) & (x0 >= 0) & (y0 >= 0) & (x1 <= width) & (y1 <= height), F.lit(False))


def same_line(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Vertical overlap of half the smaller height or more."""
    return F.least(a1, b1) - F.greatest(a0, b0) >= 0.5 * F.least(a1 - a0, b1 - b0)


def matrix_product(m: Column, n: Column) -> Column:
    """Affine matrices as structs a, b, c, d, e, f: first m, then n."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"),
        (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"),
        (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"),
        (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"),
        (m["e"] * n["a"] + m["f"] * n["c"] + n["e"]).alias("e"),
        (m["e"] * n["b"] + m["f"] * n["d"] + n["f"]).alias("f"),
    )


def apply_matrix(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def flipped(y: Column, height: float) -> Column:
    """Between page coordinates and device coordinates."""
    return F.lit(height) - y


def opened(y: Column, cut: float, height: float, floor: float) -> Column:
    """Where y goes when a gap of ``height`` opens at ``cut``: what lies from there to ``floor`` moves down."""
    return F.when((y >= cut) & (y < floor), y + height).otherwise(y)


def closed(y: Column, top: float, bottom: float, floor: float) -> Column:
    """Where y goes when the band top..bottom is taken out: null inside it, up below it as far as ``floor``."""
    return F.when((y >= top) & (y < bottom), F.lit(None)).when((y >= bottom) & (y < floor), y - (bottom - top)).otherwise(y)


def placed(align: Column, x0: Column, x1: Column, width: Column) -> Column:
    """Where a text of ``width`` starts between x0 and x1."""
    return F.when(align == "right", x1 - width).when(align == "center", (x0 + x1 - width) / 2).otherwise(x0)


def fitted(width: Column, height: Column, most_width: Column, most_height: Column) -> Column:
    """Size inside a box, aspect kept, never enlarged."""
    scale = F.least(F.lit(1.0), most_width / width, most_height / height)
    return F.struct((width * scale).alias("width"), (height * scale).alias("height"))
