"""Queries that verify an edit: bags, lost words, links, differences and publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as ft
from folio.operators import compare
from folio.plans import publish
from folio.plans.registry import query, table
from folio.sources import blocks as src

WORDS = "select conv_id, turn, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as word from conversations".replace("\\\\", "\\")


@query(
    """with w as (select lang, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as word from documents where doc_id % 10 = 0),
v as (select lang, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as word from documents where doc_id % 10 = 1)
select lang, word, count(*) as n from (select lang, word from w except all select lang, word from v) d group by lang, word""".replace("\\\\", "\\").replace("where doc_id % 10 = 0", "where lang <> 'en'").replace("where doc_id % 10 = 1", "where source < 'src2'")
)
def except_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bag of words of some languages less that of some sources."""
    docs = table(spark, sf_dir, "documents")
    a = compare.bag(src.words(docs.where("lang <> 'en'"), "lang"), ["lang"])
    b = compare.bag(src.words(docs.where("source < 'src2'"), "lang"), ["lang"])
    return compare.lost(a, b)


@query(
    f"""with w as ({WORDS}), a as (select conv_id, turn, word, count(*) as n from w group by 1, 2, 3),
t as (select distinct conv_id, turn from a), p as (select a.conv_id, a.turn + 1 as turn, word, n from a join t on t.conv_id = a.conv_id and t.turn = a.turn + 1)
select p.conv_id, p.turn, p.word, p.n - coalesce(a.n, 0) as n from p left join a on a.conv_id = p.conv_id and a.turn = p.turn and a.word = p.word where coalesce(a.n, 0) < p.n"""
)
def lost_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each turn has less often than the one before."""
    c = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    now = compare.bag(src.words(c, "key").select("key.conv_id", "key.turn", "word"), ["conv_id", "turn"])
    turns = now.select("conv_id", "turn").distinct()
    before = now.withColumn("turn", F.col("turn") + 1).join(turns, ["conv_id", "turn"], "left_semi")
    return compare.lost(before.select("conv_id", "turn", "word", "n"), now.select("conv_id", "turn", "word", "n"))


@query(
    r"""with u as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages), a as (select distinct page_id, href from u where not contains(href, 'and'))
select distinct u.page_id, u.href from u left join a using (page_id, href) where a.href is null"""
)
def links_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that an edit, which drops those with a word in them, no longer has."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return compare.missing(links, links.where(~F.contains("href", F.lit("and"))), ["page_id", "href"])


@query(
    """with b as (select p_partkey, p_size, replace(replace(p_brand, '#', ''), ' ', '') as n, p_partkey % 4 as k from part),
f as (select p_partkey, case k when 0 then 'ABCDEF+' || n || 'PS-BoldMT' when 1 then n || ',Bold' when 2 then n || 'MT' else n || '-Oblique' end as font, lower(n) as family, p_size from b),
i as (select distinct family from f where p_partkey % 97 = 0) select p_partkey, font, family from f where family not in (select family from i)"""
)
def fonts_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared fonts whose family no installed file has."""
    p = table(spark, sf_dir, "part")
    name, k = F.regexp_replace("p_brand", "[# ]", ""), F.col("p_partkey") % 4
    font = F.when(k == 0, F.concat(F.lit("ABCDEF+"), name, F.lit("PS-BoldMT"))).when(k == 1, F.concat(name, F.lit(",Bold"))).when(k == 2, F.concat(name, F.lit("MT"))).otherwise(F.concat(name, F.lit("-Oblique")))
    declared = p.select("p_partkey", font.alias("font"), "p_size").withColumn("family", ft.family(F.col("font")))
    return declared.join(declared.where("p_partkey % 97 = 0").select("family").distinct(), "family", "left_anti").select("p_partkey", "font", "family")


@query("select doc_id, sha2, crc from (select doc_id, sha256(text) as sha2, length(text) as crc from documents)".replace("length(text) as crc", "cast(length(text) as bigint) as crc").replace("select doc_id, sha2, crc", "select doc_id, sha2, crc as n_chars"))
def part_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests by which unchanged parts are told."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha2"), F.length("text").cast("bigint").alias("n_chars"))


@query(
    "with c as (select doc_id, text || '!' as text from documents where doc_id % 5 = 0) select d.doc_id, coalesce(c.text, d.text) as text, c.doc_id is not null as changed from documents d left join c using (doc_id)"
)
def package_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed parts in place of the old ones, all others as they were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = docs.where("doc_id % 5 = 0").select("doc_id", F.concat("text", F.lit("!")).alias("text"))
    return publish.rewritten(docs, changed, ["doc_id"])


@query()
def sequence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of consecutive turns as operations on words."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = lambda t: F.split(t, r"\s+")
    pairs = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), words("text").alias("new"), F.lag(words("text")).over(w).alias("old")).where("old is not null")
    return compare.opcodes(pairs)


@query()
def similar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark passage less its last three characters the nearest three of all passages."""
    b = table(spark, sf_dir, "benchmark")
    wanted = b.select(F.col("item_id").alias("key"), F.reverse(F.substring(F.reverse("text"), 4, 2**31 - 1)).alias("text"))
    return compare.nearest(wanted, b.select(F.col("text").alias("candidate")))


@query("select count(*) as n_rows, cast(sum(length(text)) as bigint) as n_chars from documents where text <> ''")
def atomic_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written to a staging path, read back and checked, and only then put in place; read from there."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")
    out = publish.published(docs, publish.scratch(spark, "atomic-publish"))
    return out.groupBy(F.lit(1).alias("k")).agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars")).drop("k")


@query("select doc_id, cast(0 as bigint) as n_written from documents where false")
def failed_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A publication that fails its check leaves nothing behind: no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    place = publish.scratch(spark, "failed-publish")
    try:
        out = publish.published(docs, place, check=lambda df: df.where("doc_id < 0").count() > 0)
    except publish.Refused:
        out = docs.where(F.lit(publish.exists(spark, place)))
    return out.select("doc_id", F.lit(0).cast("bigint").alias("n_written"))
