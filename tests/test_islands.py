"""Coalesced intervals of odd rows: without a quantity or tax, and with equals, whose order the SQL leaves open."""

from __future__ import annotations

import random

import duckdb
import pytest

from folio import catalogue

COLUMNS = ["l_orderkey", "island", "lo", "hi", "n", "every"]
SCHEMA = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double"


def written(spark, folder, rows):
    """A lineitem of (order, quantity, tax)."""
    spark.createDataFrame([(k, 1, 1, 1, q, 1.0, t) for k, q, t in rows], SCHEMA).write.parquet(str(folder / "lineitem.parquet"))
    return rows


def of_plan(spark, folder):
    return sorted((tuple(r[c] for c in COLUMNS) for r in catalogue.QUERIES["interval_coalesce"](spark, str(folder)).collect()), key=repr)


def of_sql(folder):
    with duckdb.connect() as con:
        con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
        return sorted(con.execute(f"select {', '.join(COLUMNS)} from ({catalogue.ORACLE['interval_coalesce']})").fetchall(), key=repr)


@pytest.mark.parametrize("without", ["tax", "quantity", "either"])
def test_intervals_without_an_end_come_last(spark, tmp_path, without):
    """No two rows of an order are equal in (y0, y1), so the SQL leaves nothing open."""
    rng = random.Random(5)
    rows = {}
    for k in [None, *range(60)]:
        for _ in range(rng.randint(1, 7)):
            q = None if without != "tax" and rng.random() < 0.2 else float(rng.randint(1, 50))
            t = None if without != "quantity" and rng.random() < 0.3 else rng.randint(0, 8) / 100
            y0, y1 = q, None if q is None or t is None else q + t * 50
            rows.setdefault((k, y0, y1), (k, q, t))
    written(spark, tmp_path, list(rows.values()))
    assert of_plan(spark, tmp_path) == of_sql(tmp_path)


def test_intervals_without_a_start_join_the_last_island(spark, tmp_path):
    written(spark, tmp_path, [(1, 10.0, None), (1, 10.0, 0.08), (1, None, 0.01), (1, 30.0, 0.0), (2, None, None)])
    assert of_plan(spark, tmp_path) == [(1, 1, 10.0, 14.0, 2, False), (1, 2, 30.0, 30.0, 2, True), (2, 1, None, None, 1, None)]


def test_equal_intervals_lie_in_one_island(spark, tmp_path):
    """Against a plain fold: the SQL may deal equals over two islands, as its windows are free to order them differently."""
    rng = random.Random(9)
    rows = written(spark, tmp_path, [(k, float(rng.choice((8, 16, 36, 39))), rng.choice((0.0, 0.05))) for k in range(500) for _ in range(rng.randint(1, 12))])
    folded = []
    for k in range(500):
        islands = []
        for y0, y1 in sorted((q, q + t * 50) for o, q, t in rows if o == k):
            if islands and y0 - max(e for _, e in islands[-1]) <= 1.6:
                islands[-1].append((y0, y1))
            else:
                islands.append([(y0, y1)])
        folded += [(k, i + 1, m[0][0], max(e for _, e in m), len(m), all(e - s <= 2 for s, e in m)) for i, m in enumerate(islands)]
    assert of_plan(spark, tmp_path) == sorted(folded, key=repr)
