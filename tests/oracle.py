"""Spark rows and DuckDB rows of one query, compared column by column in the order of names."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return found


def rows_of(duck, sql: str) -> tuple[list[str], list[tuple]]:
    found = duck.sql(sql)
    names = sorted(found.columns)
    order = [found.columns.index(n) for n in names]
    return names, sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
