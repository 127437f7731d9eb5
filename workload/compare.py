"""Compare a query with its oracle: column names, row count and values in any row order."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """An in-process DuckDB connection with the given Parquet tables as views."""
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _printed(value) -> str:
    if isinstance(value, float):
        return f"{value:.9g}"
    return repr(value)


def canonical(columns, rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted(tuple(_printed(row[i]) for i in order) for row in rows),
    )


def differences(spark_df, con, sql: str) -> list[str]:
    """Human-readable differences; empty when both agree."""
    expected = con.execute(sql)
    names, want = canonical([d[0] for d in expected.description], expected.fetchall())
    columns, got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if columns != names:
        return [f"columns {columns} != {names}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}"]
    return [f"{g} != {w}" for g, w in zip(got, want) if g != w][:5]
