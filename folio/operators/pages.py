"""Guards and row edits on laid-out pages.

Spans: doc_id, page, text, x0, y0, x1, y1, baseline. A page has rotation. What a guard finds are refusals: doc_id, page, reason. Pages are
joined by document and page only, so a page's rows meet in one task and are as many as a page holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import geometry as geo

KEYS = ["doc_id", "page"]
#: Slack at a band's edges and beside it, the share of a line's height that a cut may touch and how near it may come to a baseline.
EDGE, BESIDE, TOUCHED, NEAR_BASELINE = 0.3, 12.0, 0.25, 0.5
#: Grey levels by which a strip's values may differ, and the share of them that may differ by more.
STRIP_LEVELS, STRIP_SHARE = 48, 0.0004


def refusals(df: DataFrame, reason: str | Column) -> DataFrame:
    return df.select(*KEYS, (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def unusable(wanted: DataFrame, pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Pages that an edit names and that can't be edited: missing, rotated, or without text."""
    known = wanted.select(*KEYS).distinct().join(pages.select(*KEYS, "rotation"), KEYS, "left")
    texts = spans.where(F.trim("text") != "").select(*KEYS).distinct().withColumn("_text", F.lit(True))
    told = known.join(texts, KEYS, "left")
    reason = F.when(F.col("rotation").isNull(), "no such page").when(F.col("rotation") % 360 != 0, "rotated").when(F.col("_text").isNull(), "no text")
    return refusals(told.withColumn("_r", reason).where("_r is not null"), F.col("_r"))


def foreign_in_band(spans: DataFrame, bands: DataFrame) -> DataFrame:
    """Text that stands in a band (top, bottom) without being what the band is for, which lies between its x0 and x1."""
    own = bands.select(*KEYS, "top", "bottom", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    inside = (F.col("baseline") > F.col("top") + EDGE) & (F.col("baseline") < F.col("bottom") - EDGE)
    ours = (F.col("x0") >= F.col("_x0") - BESIDE) & (F.col("x1") <= F.col("_x1") + BESIDE)
    return refusals(spans.join(own, KEYS).where(inside & ~ours), F.concat(F.lit("other content: "), F.substring("text", 1, 30)))


def sliced(spans: DataFrame, cuts: DataFrame) -> DataFrame:
    """Text that a cut at y would go through."""
    through = (F.col("y") > F.col("y0") + TOUCHED * (F.col("y1") - F.col("y0"))) & (F.col("y") < F.col("baseline") - NEAR_BASELINE)
    return refusals(spans.join(cuts.select(*KEYS, "y"), KEYS).where(through), F.concat(F.lit("cuts through: "), F.substring("text", 1, 30)))


def words_inside(words: DataFrame, rects: DataFrame) -> DataFrame:
    """doc_id, page, word, n: what an edit of a rectangle may remove: words whose middle lies in it."""
    r = rects.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    middle = ((F.col("x0") + F.col("x1")) / 2).between(F.col("_x0"), F.col("_x1")) & ((F.col("y0") + F.col("y1")) / 2).between(F.col("_y0"), F.col("_y1"))
    return words.join(r, KEYS).where(middle).groupBy(*KEYS, "word").agg(F.count("*").alias("n"))


def over_fields(targets: DataFrame, fields: DataFrame) -> DataFrame:
    """Targets of a replacement that lie over a form field."""
    f = fields.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    box = lambda p: tuple(F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1"))
    return refusals(targets.join(f, KEYS).where(geo.intersects(box(""), box("_"))), "form field").distinct()


def remapped(marks: DataFrame, bands: DataFrame) -> DataFrame:
    """Links and comments (x0, y0, x1, y1) after bands (top, bottom, floor) are taken out: those whose middle was in one go, others move with
    what is below, as far as the floor."""
    joined = marks.join(bands.select(*KEYS, "top", "bottom", "floor"), KEYS, "left")
    middle, height = (F.col("y0") + F.col("y1")) / 2, F.col("bottom") - F.col("top")
    gone = F.coalesce((middle >= F.col("top")) & (middle < F.col("bottom")), F.lit(False))
    # An edge inside the band comes to lie on its upper end.
    up = lambda y: F.when((y >= F.col("top")) & (y < F.col("bottom")), F.col("top")).when((y >= F.col("bottom")) & (y < F.col("floor")), y - height).otherwise(y)
    return joined.where(~gone).select(*[up(F.col(c)).alias(c) if c in ("y0", "y1") else F.col(c) for c in marks.columns])


def closed(spans: DataFrame, bands: DataFrame, refused: DataFrame) -> DataFrame:
    """Spans after bands (top, bottom, floor) are taken out of their pages; pages in ``refused`` stay as they are."""
    applied = bands.select(*KEYS, "top", "bottom", "floor").join(refused.select(*KEYS).distinct(), KEYS, "left_anti")
    joined = spans.join(applied, KEYS, "left")
    inside = F.coalesce((F.col("baseline") >= F.col("top")) & (F.col("baseline") < F.col("bottom")), F.lit(False))
    below = F.coalesce((F.col("baseline") >= F.col("bottom")) & (F.col("baseline") < F.col("floor")), F.lit(False))
    shift = F.when(below, F.col("bottom") - F.col("top")).otherwise(F.lit(0.0))
    return joined.where(~inside).select(*[(F.col(c) - shift).alias(c) if c in ("y0", "y1", "baseline") else F.col(c) for c in spans.columns])


def strip_difference(old: Column, new: Column, old_at: Column | int, new_at: Column | int, n: Column | int) -> Column:
    """Share of a strip's n grey values, from old_at and new_at on (0-based), that differ by more than STRIP_LEVELS; 0 for an empty strip."""
    at = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    most = F.greatest(F.least(at(n), F.size(old) - at(old_at), F.size(new) - at(new_at)), F.lit(0))
    pairs = F.zip_with(F.slice(old, at(old_at) + 1, most), F.slice(new, at(new_at) + 1, most), lambda a, b: F.when(F.abs(a - b) > STRIP_LEVELS, 1).otherwise(0))
    return F.when(most > 0, F.aggregate(pairs, F.lit(0), lambda s, d: s + d) / most).otherwise(F.lit(0.0))


def strips_equal(share: Column) -> Column:
    return share <= STRIP_SHARE


#: Width of a character in sizes of its font (a model; the engine measures no glyphs), pad around a picture, slack at the floor.
CHARACTER, PAD, FLOOR_SLACK = 0.5, 8.0, 0.5


def without_room(spans: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gaps (y, height, floor) for which a page has no room: what lies from y to the floor can't move down by so much."""
    own = gaps.select(*KEYS, "y", "height", "floor")
    moving = F.max(F.when((F.col("baseline") >= F.col("y")) & (F.col("baseline") < F.col("floor")), F.col("y1")))
    bottoms = own.join(spans.select(*KEYS, "baseline", "y1"), KEYS, "left").groupBy(*KEYS, "y", "height", "floor").agg(F.coalesce(moving, F.first("y")).alias("_bottom"))
    return refusals(bottoms.where(F.col("_bottom") + F.col("height") > F.col("floor") + FLOOR_SLACK), "no room")


def opened(spans: DataFrame, gaps: DataFrame, refused: DataFrame) -> DataFrame:
    """Spans after gaps (y, height, floor) are opened: what lies from y to the floor moves down. Pages in ``refused`` stay as they are."""
    applied = gaps.select(*KEYS, "y", "height", "floor").join(refused.select(*KEYS).distinct(), KEYS, "left_anti")
    joined = spans.join(applied, KEYS, "left")
    moves = F.coalesce((F.col("baseline") >= F.col("y")) & (F.col("baseline") < F.col("floor")), F.lit(False))
    shift = F.when(moves, F.col("height")).otherwise(F.lit(0.0))
    return joined.select(*[(F.col(c) + shift).alias(c) if c in ("y0", "y1", "baseline") else F.col(c) for c in spans.columns])


def text_width(text: Column, size: Column) -> Column:
    return F.length(text) * size * CHARACTER


def selected_rows(rows: DataFrame, selectors: DataFrame) -> DataFrame:
    """doc_id, page, selector, n, row_ix: the row whose cells (array of text), joined by blanks or by pipes, hold a selector; null unless it is one."""
    flat = lambda sep: F.trim(F.regexp_replace(F.array_join("cells", sep), r"\s+", " "))
    joined = selectors.select(*KEYS, "selector").join(rows.select(*KEYS, "row_ix", flat(" ").alias("_a"), flat(" | ").alias("_b")), KEYS, "left")
    wanted = F.trim(F.regexp_replace("selector", r"\s+", " "))
    hit = (wanted != "") & (F.contains("_a", wanted) | F.contains("_b", wanted))
    counted = joined.groupBy(*KEYS, "selector").agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.col("row_ix"))).alias("row_ix"))
    return counted.withColumn("row_ix", F.when(F.col("n") == 1, F.col("row_ix")))


def set_cells(spans: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans with new texts, refusals). ``cells``: doc_id, page, span_ix, text, align, left, right: the room of the cell's column. A text that doesn't
    fit refuses; an empty one takes the span away."""
    own = cells.select(*KEYS, "span_ix", F.col("text").alias("_new"), "align", F.col("left").alias("_left"), F.col("right").alias("_right"))
    joined = spans.join(own, [*KEYS, "span_ix"], "left")
    width = text_width(F.col("_new"), F.col("size"))
    start = geo.placed(F.col("align"), F.col("x0"), F.col("x1"), width)
    wide = F.col("_new").isNotNull() & (F.col("_new") != "") & ((start < F.col("_left") - FLOOR_SLACK) | (start + width > F.col("_right") + FLOOR_SLACK))
    told = joined.withColumns({"_start": start, "_width": width, "_wide": F.coalesce(wide, F.lit(False))})
    changed = F.col("_new").isNotNull() & ~F.col("_wide")
    new = {"text": F.when(changed, F.col("_new")).otherwise(F.col("text")), "x0": F.when(changed, F.col("_start")).otherwise(F.col("x0")), "x1": F.when(changed, F.col("_start") + F.col("_width")).otherwise(F.col("x1"))}
    out = told.where(~(changed & (F.col("_new") == ""))).select(*[new[c].alias(c) if c in new else F.col(c) for c in spans.columns])
    return out, refusals(told.where("_wide"), "text doesn't fit its column")


def block_bands(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, page, top, bottom: what goes with a block (block_ix) of ``blocks`` (block_ix, y0, y1, lines): the space up to the next one, where that is less
    than three lines; else the space after the one before; else the block alone."""
    own = chosen.select(*KEYS, "block_ix").join(blocks, [*KEYS, "block_ix"]).select(*KEYS, "block_ix", F.col("y0").alias("_y0"), F.col("y1").alias("_y1"), "lines")
    near = own.join(blocks.select(*KEYS, F.col("block_ix").alias("_o"), "y0", "y1"), KEYS).groupBy(*KEYS, "block_ix", "_y0", "_y1", "lines")
    edges = near.agg(F.min(F.when((F.col("_o") != F.col("block_ix")) & (F.col("y0") >= F.col("_y1") - 0.5), F.col("y0"))).alias("_next"), F.max(F.when((F.col("_o") != F.col("block_ix")) & (F.col("y1") <= F.col("_y0") + 0.5), F.col("y1"))).alias("_before"))
    follows = F.col("_next") - F.col("_y1") < 3 * (F.col("_y1") - F.col("_y0")) / F.greatest(F.col("lines"), F.lit(1))
    top = F.when(F.coalesce(follows, F.lit(False)), F.col("_y0")).otherwise(F.coalesce("_before", "_y0"))
    return edges.select(*KEYS, "block_ix", top.alias("top"), F.when(F.coalesce(follows, F.lit(False)), F.col("_next")).otherwise(F.col("_y1")).alias("bottom"))


def picture_gap(width: Column, high: Column, wide: Column, room: Column) -> Column:
    """Height of the gap that a picture needs at a width, no wider than its room, aspect kept, with a pad on either side."""
    return F.least(width, room) * high / wide + 2 * PAD
