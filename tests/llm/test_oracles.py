"""Corpus queries against their SQL."""

import duckdb
import pytest

from foliograph.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall(), key=repr)
    assert len(got) == len(want) > 0
    assert [g for g, w in zip(got, want, strict=True) if g != w][:3] == []
