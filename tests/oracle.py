"""Compares a query with SQL on the same tables, as sorted rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows_of(rows):
    return sorted("|".join("0.0" if text(v) == "-0.0" else text(v) for v in r) for r in rows)


def compare(spark, sf, query, sql):
    """(query's rows, SQL's rows), sorted, as text."""
    got = query(spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cols = sorted(got.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols, (sorted(rel.columns), cols)
    return rows_of(got.select(*cols).collect()), rows_of(con.sql(f"select {', '.join(f'"{c}"' for c in cols)} from ({sql})").fetchall())
