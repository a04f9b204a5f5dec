"""Queries whose results SQL can express, against DuckDB."""

import duckdb
import pandas as pd
import pytest

from scriptorium.llm import registry

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list:
    text = lambda v: "NULL" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert rows(got) == rows(want)
