"""Compares a query with SQL on the same tables, as sorted rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, sf, query, sql):
    got = query(spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cols = sorted(got.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    want = sorted(str(tuple(r)) for r in con.sql(f"select {', '.join(cols)} from ({sql})").fetchall())
    assert sorted(str(tuple(r)) for r in got.select(*cols).collect()) == want
