"""Table, version and report writers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from varcost.contracts import TableSpec


# Formats that Spark writes as files, with partitions it can replace one by one.
FILE_FORMATS = ("parquet", "orc", "json", "csv")


class Written(NamedTuple):
    """Where a table went."""

    fmt: str
    target: str

    def read(self, spark: SparkSession, schema: StructType | None = None) -> DataFrame:
        """The table; without its ``schema``, months that folder names hold are read as numbers."""
        reader = spark.read.format(self.fmt)
        return (reader if schema is None else reader.schema(schema)).load(self.target)


def laid_out(
    df: DataFrame, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = (), gathered: bool = False
) -> DataFrame:
    """Arrange rows for a partitioned, clustered write.

    REBALANCE gathers each partition's rows into files of the advisory size: adaptive execution
    splits a month that is too large for one task and merges small ones. Sorting inside each
    task gives row groups narrow min/max ranges on the cluster columns, so scans skip them.

    Rows that tasks hold ``gathered`` by partition already, large ones in parts, are only sorted.
    """
    balanced = df if gathered else df.hint("rebalance", *partition_by)
    order = [*partition_by, *cluster_by]
    return balanced.sortWithinPartitions(*order) if order else balanced


def write_table(
    df: DataFrame,
    target: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
    fallback: str | None = None,
    replace_table: bool = False,
    observation: Observation | None = None,
    metrics: Sequence[Column] = (),
    finish: Callable[[DataFrame], DataFrame] | None = None,
    gathered: bool = False,
) -> Written:
    """Write a table and return where it went.

    Targets of file formats are paths; ``overwrite`` of a partitioned table replaces only the partitions
    present in ``df``, so a rerun of a month leaves one copy. Connectors get their layout through ``options``;
    they cannot be told to replace single partitions, so ``overwrite`` of a partitioned table is refused
    unless ``replace_table`` asks for it. If the format is not installed and ``fallback`` names a path, Parquet is
    written there instead; every other error is raised.

    ``metrics`` are aggregates that ``observation`` takes of the rows as they are written to files, in the tasks that write them;
    rows that go to a connector are not observed.

    ``finish`` gives rows their final columns, each row by itself, after they have been arranged: what can be computed from a row is
    not shuffled and sorted with it. It must keep the partition and cluster columns. Parquet is compressed by zstd, which halves
    the hexadecimal keys, unless ``options`` name another ``compression``.

    ``gathered`` rows are written to files from the tasks that hold them, without another shuffle, see :func:`laid_out`.
    """

    if fmt in FILE_FORMATS:
        rows = laid_out(df, partition_by, cluster_by, gathered)
        rows = rows if finish is None else finish(rows)
        writer = (rows if observation is None else rows.observe(observation, *metrics)).write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
            if mode == "overwrite":
                writer = writer.option("partitionOverwriteMode", "dynamic")
        packed = {"compression": "zstd"} if fmt == "parquet" else {}
        writer.format(fmt).options(**{**packed, **(options or {})}).save(target)
        return Written(fmt, target)
    if mode == "overwrite" and partition_by and not replace_table:
        raise ValueError(f"{fmt} may replace the whole table: append, or ask for it with replace_table")
    layout = {"table": target}
    if partition_by:
        layout["partitionField"] = partition_by[0]
    if cluster_by:
        layout["clusteredFields"] = ",".join(cluster_by)
    try:
        (df if finish is None else finish(df)).write.format(fmt).options(**layout, **(options or {})).mode(mode).save()
        return Written(fmt, target)
    except (Py4JJavaError, PySparkException) as error:
        if fallback is None or "DATA_SOURCE_NOT_FOUND" not in str(error):
            raise
    # As files, partitions can be replaced one by one, so a rerun leaves one copy.
    return write_table(
        df, fallback, "parquet", "overwrite" if partition_by else mode, partition_by, cluster_by,
        observation=observation, metrics=metrics, finish=finish, gathered=gathered,
    )


def write_spec(df: DataFrame, spec: TableSpec, base: str, **kwargs) -> Written:
    """Write a warehouse table under ``base`` with the layout of its specification."""
    return write_table(
        df if "finish" in kwargs else df.select(*spec.schema.names),
        f"{base}/{spec.name}",
        partition_by=spec.partition_by,
        cluster_by=spec.cluster_by,
        **kwargs,
    )


def write_report_json(summary: DataFrame, path: str) -> None:
    """Export data-quality summaries as JSON; there is one row per data set."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def append_audit(report: DataFrame, path: str, run_id: str) -> None:
    """Keep a run's check results in the audit table; rerunning a run id replaces its rows."""
    write_table(report.withColumn("run_id", F.lit(run_id)), path, partition_by=("run_id",))
