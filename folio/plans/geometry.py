"""Queries on rectangles, colours, units, matrices and placement. Rectangles are laid out from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import geometry as geo
from folio.functions import text as ft
from folio.operators import lookup
from folio.plans.registry import query, table

RECTS = "select p_partkey as id, p_partkey // 50 as page, (p_partkey % 50) * 11.5 as x0, p_size * 15.0 as y0, (p_partkey % 50) * 11.5 + 10 + p_size as x1, p_size * 15.0 + 20 + p_partkey % 7 as y1, p_name as text from part"


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (k % 50) * 11.5, size * 15.0
    return table(spark, sf_dir, "part").select(k.alias("id"), F.floor(k / 50).alias("page"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 10 + size).cast("double").alias("x1"), (y0 + 20 + k % 7).cast("double").alias("y1"), F.col("p_name").alias("text"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = _rects(spark, sf_dir)
    return tuple(r.where(F.col("id") % 2 == odd).select("page", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "x0", "y0", "x1", "y1")]) for odd, s in ((0, "a"), (1, "b")))


AREA = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"


@query(
    f"""with r as ({RECTS}), p as (select a.id, b.id as best, {AREA} as shared, row_number() over (partition by a.id order by {AREA} desc, b.id) as k from r a join r b on a.page = b.page and a.id % 2 = 0 and b.id % 2 = 1 where {AREA} > 0)
select id, best, cast(shared as double) as shared from p where k = 1"""
)
def rect_overlap_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rectangle the one that it overlaps most, the first of equals."""
    a, b = _sides(spark, sf_dir)
    pairs = lookup.overlapping(a, b, ["page"], "y0_a", "y1_a", "y0_b", "y1_b", 40.0)
    shared = geo.overlap_area(tuple(F.col(f"{c}_a") for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"{c}_b") for c in ("x0", "y0", "x1", "y1")))
    found = pairs.withColumn("shared", shared).where("shared > 0")
    return lookup.best(found, ["id_a"], [F.desc("shared"), F.col("id_b")]).select(F.col("id_a").alias("id"), F.col("id_b").alias("best"), "shared")


@query(f"with r as ({RECTS}) select a.id from r a where a.id % 2 = 0 and not exists (select 1 from r b where b.page = a.page and b.id % 2 = 1 and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1)")
def empty_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles that meet nothing of the other kind: an anti-join on bins."""
    a, b = _sides(spark, sf_dir)
    pairs = lookup.overlapping(a, b, ["page"], "y0_a", "y1_a", "y0_b", "y1_b", 40.0)
    hit = pairs.where(geo.intersects(tuple(F.col(f"{c}_a") for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"{c}_b") for c in ("x0", "y0", "x1", "y1"))))
    return a.select("id_a").join(hit.select("id_a").distinct(), "id_a", "left_anti").select(F.col("id_a").alias("id"))


@query(f"with r as ({RECTS}) select a.id as a, b.id as b from r a join r b on a.page = b.page and a.id % 2 = 0 and b.id % 2 = 1 where least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.5 * least(a.y1 - a.y0, b.y1 - b.y0)")
def same_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that overlap vertically by half the smaller height or more."""
    a, b = _sides(spark, sf_dir)
    pairs = lookup.overlapping(a, b, ["page"], "y0_a", "y1_a", "y0_b", "y1_b", 40.0)
    return pairs.where(geo.same_line(F.col("y0_a"), F.col("y1_a"), F.col("y0_b"), F.col("y1_b"))).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


@query(f"with r as ({RECTS}) select a.id, coalesce(max(b.x1) filter (where b.x1 <= a.x0 + 0.5), 0) as cast_left, count(b.id) as n from r a left join r b on a.page = b.page and b.id <> a.id and least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0 group by a.id, a.x0".replace("coalesce(max(b.x1) filter (where b.x1 <= a.x0 + 0.5), 0) as cast_left", "cast(coalesce(max(b.x1) filter (where b.x1 <= a.x0 + 0.5), 0) as double) as left_edge"))
def free_space_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right edge of the nearest rectangle to the left on the same height, 0 without one."""
    r = _rects(spark, sf_dir).drop("text")
    a = r.select("page", *[F.col(c).alias(f"{c}_a") for c in ("id", "x0", "y0", "x1", "y1")])
    b = r.select("page", *[F.col(c).alias(f"{c}_b") for c in ("id", "x0", "y0", "x1", "y1")])
    pairs = lookup.overlapping(a, b, ["page"], "y0_a", "y1_a", "y0_b", "y1_b", 40.0).where("id_a <> id_b")
    near = pairs.groupBy("id_a").agg(F.max(F.when(F.col("x1_b") <= F.col("x0_a") + 0.5, F.col("x1_b"))).alias("left_edge"), F.count("*").alias("n"))
    return r.join(near, r["id"] == near["id_a"], "left").select("id", F.coalesce("left_edge", F.lit(0.0)).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with r as ({RECTS}) select a.id, count(*) as n from r a join r b on a.page = b.page and abs(floor(a.x1 / 40) * 40 - floor(b.x1 / 40) * 40) <= 1 and abs(a.y0 - b.y0) <= 24 group by a.id having count(*) >= 2")
def shared_right_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles whose right edge, on a grid of 40, another one nearby has, too."""
    r = _rects(spark, sf_dir).withColumn("x1", F.floor(F.col("x1") / 40) * 40)
    a = r.select("page", F.col("id").alias("id_a"), F.col("x1").alias("x1_a"), F.col("y0").alias("y_a"), (F.col("y0") - 24).alias("lo"), (F.col("y0") + 24).alias("hi"))
    b = r.select("page", F.col("x1").alias("x1_b"), F.col("y0").alias("b0"), F.col("y0").alias("b1"))
    pairs = lookup.overlapping(a, b, ["page"], "lo", "hi", "b0", "b1", 48.0).where(F.abs(F.col("x1_a") - F.col("x1_b")) <= 1)
    return pairs.groupBy(F.col("id_a").alias("id")).agg(F.count("*").alias("n")).where("n >= 2")


@query(f"with r as ({RECTS}) select id, x0 < x1 and y0 < y1 and x0 >= 0 and y0 >= 0 and x1 <= 595 and y1 <= 700 as inside from r")
def rect_in_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rects(spark, sf_dir).select("id", geo.valid_rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], 595, 700).alias("inside"))


@query("select p_partkey, ((p_partkey * 7919) % 16777216 // 65536) / 255.0 as r, ((p_partkey * 7919) % 16777216 // 256 % 256) / 255.0 as g, ((p_partkey * 7919) % 256) / 255.0 as b, lower(printf('%06x', (p_partkey * 7919) % 16777216)) as hex from part".replace("/ 255.0", "/ cast(255 as double)"))
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24-bit colours as shares of one and back from their hexadecimal form."""
    value = (F.col("p_partkey") * 7919) % 16777216
    p = table(spark, sf_dir, "part").select("p_partkey", geo.colour_parts(value).alias("c"), F.lower(F.lpad(F.hex(value), 6, "0")).alias("hex"))
    back = F.lower(F.lpad(F.hex(geo.hex_colour(F.concat(F.lit("#"), F.col("hex")))), 6, "0"))
    return p.select("p_partkey", F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b"), back.alias("hex"))


@query("select p_partkey, cast(round_even(p_retailprice * 20, 0) as bigint) as twips, cast(round_even(p_retailprice * 2, 0) as bigint) as halves, p_retailprice * 12700 / 360000 as cm from part")
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    price = F.col("p_retailprice")
    return p.select("p_partkey", geo.points_to_twips(price).alias("twips"), geo.points_to_halves(price).alias("halves"), geo.emu_to_cm(price * geo.EMU_PER_POINT).alias("cm"))


@query("select p_partkey, 2 * (p_size + 3.0) + 5 as x, -1 * (2.0 * p_partkey - 4) + 7 as y from part".replace("(p_size + 3.0)", "(cast(p_size as double) + 3)").replace("2.0 * p_partkey", "cast(2 as double) * p_partkey"))
def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points through the product of two affine matrices."""
    m = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("abcdef", (1, 0, 0, 2, 3, -4), strict=True)])
    n = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("abcdef", (2, 0, 0, -1, 5, 7), strict=True)])
    point = geo.apply_matrix(geo.matrix_product(m, n), F.col("p_size").cast("double"), F.col("p_partkey").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", point.alias("p")).select("p_partkey", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query(
    f"""with r as ({RECTS}) select id, case id % 3 when 0 then cast(x0 as double) when 1 then cast(x1 - (x1 - x0) / 2 as double) else cast((x0 + x1 - (x1 - x0) / 2) / 2 as double) end as x,
cast((x1 - x0) * least(1, 25 / (x1 - x0), 22 / (y1 - y0)) as double) as width from r"""
)
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where aligned texts start, and widths of pictures fitted into a box."""
    r = _rects(spark, sf_dir)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    align = F.when(F.col("id") % 3 == 0, "left").when(F.col("id") % 3 == 1, "right").otherwise("center")
    return r.select("id", geo.placed(align, F.col("x0"), F.col("x1"), w / 2).alias("x"), geo.fitted(w, h, F.lit(25.0), F.lit(22.0))["width"].alias("width"))


@query("select p_partkey, replace(replace(replace('<' || p_name || ' & ' || p_brand || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped, rtrim(rtrim(printf('%.5f', p_retailprice / 8), '0'), '.') as number from part")
def written_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts escaped for markup and numbers with five places at most; unescaping gives the text back."""
    p = table(spark, sf_dir, "part").withColumn("raw", F.concat(F.lit("<"), "p_name", F.lit(" & "), "p_brand", F.lit(">")))
    safe = ft.escaped(F.col("raw"))
    back = ft.unescaped(safe) == F.col("raw")
    return p.where(back).select("p_partkey", safe.alias("escaped"), ft.trimmed_decimal(F.col("p_retailprice") / 8).alias("number"))


@query(f"with r as ({RECTS}), s as (select page, id, id * 100.0 as a, id * 100.0 + 50 + id % 3 * 60 as z from r) select s.page, count(o.id) as n_bad, count(distinct s.id) as n from s left join s o on o.page = s.page and o.id < s.id and o.a <= s.z and s.a <= o.z group by s.page")
def overlapping_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacement targets of a page that overlap an earlier one."""
    r = _rects(spark, sf_dir)
    spans = r.select("page", "id", (F.col("id") * 100.0).alias("s0"), (F.col("id") * 100.0 + 50 + F.col("id") % 3 * 60).alias("s1"))
    other = spans.select("page", F.col("id").alias("o"), F.col("s0").alias("o0"), F.col("s1").alias("o1"))
    bad = lookup.overlapping(spans, other, ["page"], "s0", "s1", "o0", "o1", 200.0).where("o < id").groupBy("page").agg(F.count("*").alias("n_bad"))
    return r.groupBy("page").agg(F.count("*").alias("n")).join(bad, "page", "left").select("page", F.coalesce("n_bad", F.lit(0)).alias("n_bad"), "n")
