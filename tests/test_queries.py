"""Every registered contact query against its SQL in DuckDB, at the smallest scale."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from namewright.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return ""
        return str(v) if isinstance(v, (bool, str)) or type(v).__name__ == "bool_" else f"{float(v):.6g}"

    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), db.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).columns


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
