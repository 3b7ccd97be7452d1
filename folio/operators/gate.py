"""Rules of the quality gate. Each is a query that returns findings: doc_id, page, severity (E or W), code, message.

Spans: doc_id, page, text, size, x0, y0, x1, y1. Pages: doc_id, page, width, height. Drawings: doc_id, page, draw_ix, x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as geo
from folio.functions import text as ft
from folio.operators import layout

#: Tolerances and shares of the page height or width that the rules go by.
OUTSIDE, RIGHT_OVER, RIGHT_EDGE = 2.0, 36.0, 20.0
HEADING_SIZE, HEADING_FROM, HOLE_UNDER, FOOTER_FROM, LAST_UNDER = 1.15, 0.60, 0.55, 0.90, 0.15
OVERPRINT_SHARE, OVERPRINT_HEIGHT, OVERPRINT_CHARS = 0.3, 0.7, 4
LEAST_ROWS, MOST_WRAPPED, ROW_TOLERANCE, ZONE_TOP, ZONE_BOTTOM = 3, 4, 2.0, 0.07, 0.93
PIXEL_LEVELS, PIXEL_SHARE = 40, 0.0005


def findings(df: DataFrame, severity: str | Column, code: str, message: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("doc_id", "page", sev.alias("severity"), F.lit(code).alias("code"), message.alias("message"))


def placeholders(spans: DataFrame) -> DataFrame:
    """Every place-holder or broken reference with 30 characters around it."""
    hits = spans.where(ft.has_placeholder(F.col("text"))).withColumn("hit", F.explode(ft.placeholder_contexts(F.col("text"))))
    return findings(hits, "E", "placeholder", F.col("hit"))


def missing_glyphs(spans: DataFrame) -> DataFrame:
    return findings(spans.where(ft.has_missing_glyph(F.col("text"))), "E", "glyph", F.col("text"))


def blank_pages(pages: DataFrame, *contents: DataFrame) -> DataFrame:
    out = pages
    for c in contents:
        out = out.join(c.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    return findings(out, "E", "blank", F.lit("blank page"))


def outside(spans: DataFrame, pages: DataFrame) -> DataFrame:
    joined = spans.join(pages, ["doc_id", "page"])
    bad = (F.col("x0") < -OUTSIDE) | (F.col("y0") < -OUTSIDE) | (F.col("x1") > F.col("width") + OUTSIDE) | (F.col("y1") > F.col("height") + OUTSIDE)
    return findings(joined.where(bad), "E", "outside", F.substring("text", 1, 30))


def drawings_outside(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """The first of each page only."""
    joined = drawings.join(pages, ["doc_id", "page"])
    bad = (F.col("x0") < -OUTSIDE) | (F.col("y0") < -OUTSIDE) | (F.col("x1") > F.col("width") + OUTSIDE) | (F.col("y1") > F.col("height") + OUTSIDE)
    first = joined.where(bad).groupBy("doc_id", "page").agg(F.min("draw_ix").alias("draw_ix"))
    return findings(first, "E", "drawing", F.concat(F.lit("drawing "), F.col("draw_ix").cast("string")))


def modal_sizes(spans: DataFrame) -> DataFrame:
    """doc_id, size: the most frequent font size, rounded to a tenth, the smallest of equals."""
    counts = spans.groupBy("doc_id", F.bround("size", 1).alias("mode")).agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "mode"))).where("k = 1").select("doc_id", "mode")


def _numbered(pages: DataFrame) -> DataFrame:
    """``pages`` with ``last``: the document's last page, whether anything stands on it or not."""
    return pages.withColumn("last", F.max("page").over(Window.partitionBy("doc_id")))


def stranded_headings(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """A page's last line, ending low on it and larger than the text, on any page but the document's last."""
    real = spans.where(F.trim("text") != "")
    last = real.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("y1"), "x0", "text"))).where("k = 1")
    sized = last.join(modal_sizes(spans), "doc_id").join(_numbered(pages), ["doc_id", "page"])
    bad = (F.col("page") < F.col("last")) & (F.col("size") > HEADING_SIZE * F.col("mode")) & (F.col("y1") > HEADING_FROM * F.col("height"))
    return findings(sized.where(bad), "W", "stranded", F.col("text"))


def holes(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Middle pages whose content, what ends in the footer aside, ends early; and a document's last page if it holds next to nothing."""
    joined = spans.join(_numbered(pages), ["doc_id", "page"])
    above = F.max(F.when(F.col("y1") < FOOTER_FROM * F.col("height"), F.col("y1")))
    ends = joined.groupBy("doc_id", "page", "height", "last").agg(F.max("y1").alias("end"), above.alias("body"))
    middle = ends.where((F.col("page") > 1) & (F.col("page") < F.col("last")) & (F.col("body") < HOLE_UNDER * F.col("height")))
    final = ends.where((F.col("page") == F.col("last")) & (F.col("last") > 1) & (F.col("end") < LAST_UNDER * F.col("height")))
    percent = lambda c: F.concat(F.round(100 * F.col(c) / F.col("height"), 0).cast("int").cast("string"), F.lit(" %"))
    return findings(middle, "W", "hole", percent("body")).unionAll(findings(final, "W", "last_page", percent("end")))


def right_edge(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines beyond the text's usual right margin and close to the page's edge."""
    margins = layout.by_rank(spans, ["doc_id"], "x1").select("doc_id", F.col("high").alias("margin"))
    joined = spans.join(margins, "doc_id").join(pages, ["doc_id", "page"])
    return findings(joined.where((F.col("x1") > F.col("margin") + RIGHT_OVER) & (F.col("x1") > F.col("width") - RIGHT_EDGE)), "E", "right_edge", F.col("text"))


def overprinted(spans: DataFrame, bin_height: float = 24.0) -> DataFrame:
    """doc_id, page, a, b: pairs of lines (line_ix) of like height that overlap by more than their share of the smaller one.

    Lines meet only in the height bins that they touch, so a page isn't compared with itself line by line.
    """
    real = spans.where(F.length(F.trim("text")) > OVERPRINT_CHARS).select("doc_id", "page", "line_ix", "x0", "y0", "x1", "y1")
    binned = real.withColumn("bin", F.explode(F.sequence(F.floor(F.col("y0") / bin_height), F.floor(F.col("y1") / bin_height))))
    a, b = (binned.select("doc_id", "page", "bin", *[F.col(c).alias(f"{c}_{s}") for c in ("line_ix", "x0", "y0", "x1", "y1")]) for s in "ab")
    joined = a.join(b, ["doc_id", "page", "bin"]).where("line_ix_a < line_ix_b")
    box = lambda s: tuple(F.col(f"{c}_{s}") for c in ("x0", "y0", "x1", "y1"))
    height = lambda s: F.col(f"y1_{s}") - F.col(f"y0_{s}")
    shared, small = geo.overlap_area(box("a"), box("b")), F.least(geo.area(*box("a")), geo.area(*box("b")))
    like = F.least(height("a"), height("b")) >= OVERPRINT_HEIGHT * F.greatest(height("a"), height("b"))
    first = F.col("bin") == F.floor(F.greatest(F.col("y0_a"), F.col("y0_b")) / bin_height)
    hits = joined.where(like & first & (shared > 0) & (shared / F.when(small > 0, small).otherwise(1.0) > OVERPRINT_SHARE))
    return hits.select("doc_id", "page", F.col("line_ix_a").alias("a"), F.col("line_ix_b").alias("b"))


def split_tables(rows: DataFrame) -> DataFrame:
    """Tables that leave fewer than LEAST_ROWS rows before a page break, seen by the header that the next page repeats.

    ``rows``: doc_id, page, row_ix, n_cells, text. A page's rows are folded into one array, which its size bounds.
    """
    row = F.struct("row_ix", "n_cells", "text")
    packed = rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    wide = F.filter("rows", lambda r: r["n_cells"] >= 2)
    head = packed.where((F.size(wide) > 0)).select("doc_id", (F.col("page") - 1).alias("page"), F.element_at(wide, 1)["text"].alias("head"), F.element_at(wide, 1)["row_ix"].alias("at"), F.element_at("rows", 1)["row_ix"].alias("first"))
    joined = packed.join(head.where(F.col("at") - F.col("first") <= 1).drop("at", "first"), ["doc_id", "page"])
    places = F.transform(F.filter("rows", lambda r: r["text"] == F.col("head")), lambda r: r["row_ix"])
    found = joined.withColumn("at", F.array_max(places)).where("at is not null")
    after = F.aggregate(
        F.filter("rows", lambda r: r["row_ix"] > F.col("at")),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("wrapped")),
        lambda acc, r: F.when(acc["wrapped"] > MOST_WRAPPED, acc).when(r["n_cells"] < 2, F.struct(acc["n"].alias("n"), (acc["wrapped"] + 1).alias("wrapped"))).otherwise(F.struct((acc["n"] + 1).alias("n"), F.lit(0).alias("wrapped"))),
        lambda acc: acc["n"],
    )
    short = found.withColumn("after", after).where(F.col("after") < LEAST_ROWS)
    return findings(short, "E", "table_split", F.concat(F.col("after").cast("string"), F.lit(" row(s) before the break")))


def contents_without_leaders(heads: DataFrame) -> DataFrame:
    """doc_id, page, has_toc, text: documents with a contents field whose first pages show fewer than two leader lines."""
    return findings(heads.where(F.col("has_toc") & (ft.leader_lines(F.col("text")) < 2)), "E", "contents", F.lit("contents are empty"))


def page_counts(before: DataFrame, after: DataFrame, reflow: bool = False) -> DataFrame:
    a = before.groupBy("doc_id").agg(F.count("*").alias("old"))
    b = after.groupBy("doc_id").agg(F.count("*").alias("new"))
    joined = a.join(b, "doc_id", "full").where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("page", F.lit(None).cast("bigint"))
    return findings(joined, "W" if reflow else "E", "page_count", F.concat_ws(" -> ", F.coalesce("old", F.lit(0)).cast("string"), F.coalesce("new", F.lit(0)).cast("string")))


def raster_difference(old: Column, new: Column, levels: int = PIXEL_LEVELS) -> Column:
    """Share of grey values that differ by more than ``levels``; 1 if the sizes differ."""
    off = F.aggregate(F.zip_with(old, new, lambda a, b: F.when(F.abs(a - b) > levels, 1).otherwise(0)), F.lit(0), lambda n, d: n + d)
    return F.when(F.size(old) != F.size(new), F.lit(1.0)).otherwise(off / F.greatest(F.size(old), F.lit(1)))


def downgraded(now: DataFrame, original: DataFrame) -> DataFrame:
    """Findings; errors whose text the original has, too, are warnings."""
    known = original.where("severity = 'E'").select("doc_id", "code", "message").distinct().withColumn("old", F.lit(True))
    joined = now.join(known, ["doc_id", "code", "message"], "left")
    return joined.select("doc_id", "page", F.when(F.col("old"), F.lit("W")).otherwise(F.col("severity")).alias("severity"), "code", "message")


def verdicts(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, errors, warnings, passed."""
    counts = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "E").alias("errors"), F.count_if(F.col("severity") == "W").alias("warnings"))
    joined = documents.join(counts, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))
