"""Comparison of a query's rows with its SQL in DuckDB."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, list):
        return tuple(map(_plain, v))
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(_plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)


def sql_rows(connection, sql):
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, sorted((tuple(_plain(r[k]) for k in order) for r in result.fetchall()), key=repr)
