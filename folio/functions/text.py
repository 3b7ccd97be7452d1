"""Text functions on columns. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as table cells write it, with sign, groups, decimal comma or point and a unit or percent sign.
NUMBER = r"^[\s+\-−–]?[\d\s\u00a0.,]+\s*(%|‰|₽|\$|€|п\.п\.|млн|млрд|тыс\.?)?$"
#: What templates leave behind when they are not filled in, and broken references.
PLACEHOLDERS = r"\{\{|\}\}|\{%|TODO|TBD|XXX|Lorem ipsum|Error! Reference|Ошибка! Источник|Ошибка! Закладка|Error! Bookmark|\?\?\?"
PLACEHOLDER = "(?iu)" + PLACEHOLDERS
#: Short words that don't end a line, and units that stay with their number.
SHORT_WORDS = "в|во|и|с|со|к|ко|о|об|у|а|я|на|не|но|по|за|из|до|от|для|без|или"
UNITS = r"%|‰|₽|\$|€|млн|млрд|тыс|руб|кг|км|мм|см|п\.п\.|г\."
#: Characters that stand where a glyph is missing.
MISSING_GLYPHS = "�□"
#: A line of a table of contents: dots leading to a page number at its end.
LEADER = r"(?m)\.{5,}\s*\d+\s*$"


def quoted(literal: str) -> str:
    """A pattern that matches the literal."""
    return re.escape(literal)


def literal_count(text: Column, find: str | Column) -> Column:
    """Non-overlapping occurrences; an empty or null ``find`` has none."""
    find = F.lit(find) if isinstance(find, str) else find
    n = (F.length(text) - F.length(F.replace(text, find, F.lit("")))) / F.length(find)
    return F.when(F.length(find) > 0, n.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def literal_offsets(text: Column, find: str) -> Column:
    """Zero-based offsets of the non-overlapping occurrences, in order."""
    parts = F.split(text, quoted(find), -1)
    step = len(find)
    running = F.aggregate(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, part: F.struct((acc["at"] + F.length(part) + step).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(part))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.when(text.isNotNull(), running)


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that both start with."""
    most = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    first = F.array_position(same, F.lit(False))
    return F.when(most == 0, F.lit(0)).when(first == 0, most).otherwise((first - 1).cast("int")).cast("bigint")


def common_suffix(a: Column, b: Column, prefix: Column) -> Column:
    """Characters that both end with, outside a common prefix of so many characters."""
    rest = lambda c: F.reverse(F.substring(c, (prefix + 1).cast("int"), F.length(c)))
    return common_prefix(rest(a), rest(b))


def collapsed(text: Column) -> Column:
    """White space of any kind, no-break and thin spaces too, as single spaces; soft hyphens dropped; ends trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("­"), F.lit("")), r"(?U)\s+", " "))


def digits_masked(text: Column, sign: str = "#") -> Column:
    return F.regexp_replace(text, r"[0-9]+", sign)


def reason_key(text: Column, most: int = 110) -> Column:
    """A message without its particulars: numbers as N, quoted parts as an ellipsis, cut."""
    plain = F.regexp_replace(F.regexp_replace(text, r"op \d+ \((\w+)\)", "$1"), r"'[^']*'|\"[^\"]*\"|\[[^\]]*\]", "…")
    return F.substring(F.regexp_replace(plain, r"\d+", "N"), 1, most)


def is_number(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("(?U)" + NUMBER), F.lit(False))


def has_placeholder(text: Column) -> Column:
    return F.coalesce(text.rlike(PLACEHOLDER), F.lit(False))


def placeholder_contexts(text: Column, around: int = 30) -> Column:
    """Every hit with so many characters on either side, also where hits stand close together: places first, contexts after."""
    hits = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    pieces = F.zip_with(F.transform(F.split(text, PLACEHOLDER, -1), F.length), F.transform(hits, F.length), lambda gap, hit: F.struct(gap.alias("gap"), F.coalesce(hit, F.lit(0)).alias("hit")))
    places = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(hits)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,z:int>>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + p["gap"] + p["hit"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("a"), (acc["at"] + p["gap"] + p["hit"]).alias("z")))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.transform(places, lambda p: F.substring(text, F.greatest(p["a"] - around, F.lit(0)) + 1, p["z"] + around - F.greatest(p["a"] - around, F.lit(0))))


def has_missing_glyph(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[{MISSING_GLYPHS}]"), F.lit(False))


def leader_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LEADER)).cast("bigint")


def escaped(text: Column) -> Column:
    """The five characters that markup reserves, as entities."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for char, entity in (("'", "&#39;"), ('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def preview(text: Column, most: int = 90) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def family(name: Column) -> Column:
    """A font's family for comparison: subset prefix, style and signs dropped, lower case."""
    bare = F.element_at(F.split(F.element_at(F.split(name, r"\+"), -1), "[-,]"), 1)
    return F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]", ""), "(psmt|mt|ps)$", "")


def trimmed_decimal(value: Column, places: int = 5) -> Column:
    """A number with so many places at most, without zeros at its end."""
    text = F.format_string(f"%.{places}f", value)
    text = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    return F.when(text.isin("-0", ""), F.lit("0")).otherwise(text)


def glued(text: Column) -> Column:
    """No-break spaces after short words and before a long dash, narrow ones between a number and its unit."""
    text = F.regexp_replace(text, rf"(?iu)(?<=^|\s)({SHORT_WORDS})\s", "$1\u00a0")
    text = F.regexp_replace(text, rf"(?<=\d) (?={UNITS})", "\u202f")
    return F.replace(text, F.lit(" — "), F.lit("\u00a0— "))


def reversed_words(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), F.reverse), " ")
