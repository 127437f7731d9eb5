"""Warehouse table definitions for the Spark catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varcost.contracts import WAREHOUSE, TableSpec
from varcost.sinks.writers import laid_out


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def create_table_sql(spec: TableSpec, database: str, location: str | None = None) -> str:
    """Idempotent CREATE TABLE with defaults, comments, labels and partitions; at ``location`` if one is given.

    Spark does not enforce NOT NULL on Parquet tables; required columns are declared in the
    ``required`` property and counted by the data-quality suites.
    """
    defaults, comments = dict(spec.defaults), dict(spec.column_comments)
    columns = ",\n  ".join(
        f"`{f.name}` {f.dataType.simpleString()}"
        + (f" DEFAULT {defaults[f.name]}" if f.name in defaults else "")
        + (f" COMMENT {_text(comments[f.name])}" if f.name in comments else "")
        for f in spec.schema
    )
    properties = {
        **dict(spec.labels),
        "required": ",".join(f.name for f in spec.schema if not f.nullable),
        "cluster_by": ",".join(spec.cluster_by),
    }
    parts = [
        f"CREATE TABLE IF NOT EXISTS `{database}`.`{spec.name}` (\n  {columns}\n) USING parquet",
        # INSERT OVERWRITE replaces the partitions it writes, from SQL as well.
        f"OPTIONS (partitionOverwriteMode 'dynamic')\nPARTITIONED BY ({', '.join(spec.partition_by)})"
        if spec.partition_by else "",
        f"LOCATION {_text(location)}" if location else "",
        f"COMMENT {_text(spec.comment)}",
        "TBLPROPERTIES (" + ", ".join(f"{_text(k)} = {_text(v)}" for k, v in properties.items()) + ")",
    ]
    return "\n".join(p for p in parts if p)


def create_warehouse(spark: SparkSession, database: str) -> None:
    """Create the database and its four tables, keeping those that exist."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for spec in WAREHOUSE.values():
        spark.sql(create_table_sql(spec, database))


def insert_table(df: DataFrame, database: str, spec: TableSpec) -> None:
    """Replace a catalogue table's content, or of a partitioned one the partitions in ``df``."""
    name = f"`{database}`.`{spec.name}`"
    columns = df.sparkSession.table(name).columns  # insertInto goes by position
    rows = laid_out(df.select(*columns), spec.partition_by, spec.cluster_by)
    rows.write.insertInto(name, overwrite=True)
