"""Order-insensitive comparison of a Spark result with DuckDB SQL."""

from __future__ import annotations


def rows_of(df) -> tuple[list[str], list[str]]:
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


def rows_of_sql(duck, sql: str) -> tuple[list[str], list[str]]:
    rel = duck.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
