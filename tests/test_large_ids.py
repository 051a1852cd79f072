"""Queries that number rows of their own, on tables whose ids reach those numbers."""

from collections import Counter

import duckdb

from namewright.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_train_ids_keeps_added_rows_that_share_an_id(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT * REPLACE (p_partkey + k AS p_partkey) FROM read_parquet('{DATA}/part.parquet'), (VALUES (0), (1000000)) AS s(k)) TO '{tmp_path}/part.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet')")
    want = Counter(r[0] for r in con.execute(catalog.ORACLE_SQL["train_ids"]).fetchall())
    assert max(want.values()) == 2
    assert Counter(r.id for r in catalog.QUERIES["train_ids"](spark, str(tmp_path)).collect()) == want
