"""Ordered blocks, cells, tokens and ops from text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OP_ARGS = T.MapType(T.StringType(), T.StringType())


def text_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, block_ix (from 0), text: the lines of each document in order."""
    return docs.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("block_ix", "text"))


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, block_ix, kind (heading, list, quote, table, rule or paragraph), level (headings, from 1), text without its marks."""
    lines = text_blocks(docs, key, text).where(F.trim("text") != "")
    marks = F.regexp_extract("text", r"^(#{1,6}) ", 1)
    kind = (
        F.when(marks != "", "heading")
        .when(F.col("text").rlike(r"^\s*([-*+]|\d+\.) "), "list")
        .when(F.col("text").rlike(r"^> ?"), "quote")
        .when(F.col("text").rlike(r"^\s*\|"), "table")
        .when(F.col("text").rlike(r"^(---|\*\*\*|___)\s*$"), "rule")
        .otherwise("paragraph")
    )
    bare = F.regexp_replace("text", r"^(#{1,6} |\s*(?:[-*+]|\d+\.) |> ?)", "")
    return lines.select(key, "block_ix", kind.alias("kind"), F.when(marks != "", F.length(marks)).alias("level"), bare.alias("text"))


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, block_ix, tag, level (h1 = 0), text: opening tags in order with the text up to the next tag, and text that follows a closing tag
    or stands before any, with an empty tag.

    Scripts, styles and comments are dropped first; tags need not be closed; a sign that opens no tag is text.
    """
    bare = F.regexp_replace(F.col(html), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"<([^a-zA-Z/!?])", "&lt;$1")
    parts = F.regexp_extract_all(bare, F.lit(r"(?s)^[^<]+|<[/!?]?[a-zA-Z][^>]*>[^<]*"), F.lit(0))
    told = F.filter(parts, lambda p: p.rlike("^<[a-zA-Z]") | (F.trim(F.regexp_replace(p, r"(?s)^<[^>]*>", "")) != ""))
    tags = pages.select(F.col(key), F.posexplode(told).alias("block_ix", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([a-zA-Z][a-zA-Z0-9]*)", 1))
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int") - 1)
    return tags.select(key, "block_ix", tag.alias("tag"), level.alias("level"), F.trim(F.regexp_replace("raw", r"(?s)^<[^>]*>", "")).alias("text"))


def pipe_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, block_ix, cells: lines that hold a pipe, cut at the pipes, cells trimmed."""
    rows = text_blocks(docs, key, text).where(F.contains("text", F.lit("|")))
    return rows.select(key, "block_ix", F.transform(F.split("text", r"\|"), lambda c: F.trim(c)).alias("cells"))


def cells(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, row_ix, col_ix, text of rows with an array of cells."""
    return rows.select(key, F.col("block_ix").alias("row_ix"), F.posexplode("cells").alias("col_ix", "text"))


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, word_ix, word: what stands between white space, in order."""
    return docs.select(F.col(key), F.posexplode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("word_ix", "word"))


def ops(log: DataFrame, by: str, order: list[str], op: str, args: str) -> DataFrame:
    """by, op_ix (from 0), op, args (map): the ops of each ``by`` in their order, from a log with JSON arguments."""
    window = Window.partitionBy(by).orderBy(*order)
    return log.select(by, (F.row_number().over(window) - 1).alias("op_ix"), F.col(op).alias("op"), F.from_json(args, OP_ARGS).alias("args"))
