"""The queries on the driver's smallest tables, against SQL where there is some."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from folio.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    source = "embeddings" if name.startswith("op4_") else "documents"
    rows = df.collect()
    assert len(rows) == spark.read.parquet(str(DATA / f"{source}.parquet")).count()
    if name in queries.ORACLE:
        con = duckdb.connect()
        con.execute(f"create view {source} as select * from '{DATA / source}.parquet'")
        result = con.execute(queries.ORACLE[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(map(tuple, result.fetchall()))
