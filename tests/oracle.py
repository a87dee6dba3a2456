"""Compare a query's rows with those of its SQL on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.5f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    """None, or what differs first."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    theirs = rows_of(columns, got.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    return next((f"{a} and {b}" for a, b in zip(mine, theirs) if a != b), None)
