"""Values of a query against those of its DuckDB SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def norm(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, list):
        return [norm(y) for y in x]
    return int(x) if type(x).__name__ == "Decimal" and x == int(x) else x


def expected(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    con.execute(sql)
    names = [d[0] for d in con.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([norm(r[i]) for i in order]) for r in con.fetchall())


def got(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([norm(v) for v in r]) for r in df.select(*(f"`{c}`" for c in cols)).collect())
