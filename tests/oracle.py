"""Compares a query's rows with those of its SQL on the same tables."""

from collections import Counter
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(value):
    return round(value, 6) if isinstance(value, float) else tuple(value) if isinstance(value, list) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


def compare(spark, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = query(spark, str(DATA))
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got, other = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    assert got == other, (list((got - other).items())[:3], list((other - got).items())[:3])
    return sum(got.values())
