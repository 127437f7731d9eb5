"""Appends that can be run again: a ledger says which load of a month counts.

For targets that can only append. Every load writes its months under a name of its own; only when all files are there
does the ledger get a row per month. Readers take, for each month, the load committed last, so a load that broke
midway is never seen, and a month that was loaded again has one copy. A run that is repeated skips the months it has
already committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varcost.sinks.writers import laid_out

LEDGER = "run_id string, periodo string, load string, filas long, archivos long, orden long"


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], LEDGER)
        raise


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's row in force of each month: ``periodo`` and the columns of its last commit."""
    columns = ["run_id", "load", "filas", "archivos", "orden"]
    latest = _read(spark, path).groupBy("periodo").agg(F.max_by(F.struct(*columns), F.struct("orden", "load")).alias("last"))
    return latest.select("periodo", "last.*")


def append_once(
    df: DataFrame, path: str, run_id: str, month: str = "periodo", cluster_by: Sequence[str] = (), replace: bool = False
) -> list[str]:
    """Append the months of ``df`` that this run has not committed yet and commit them; returns these months.

    With ``replace`` all months are loaded, and replace what the run committed before. ``month`` must not be NULL. Rows of the
    ledger and months of a load are few; only they come to the driver.
    """
    spark = df.sparkSession
    ledger = _read(spark, path)
    done = [] if replace else [r[0] for r in ledger.filter(F.col("run_id") == run_id).select("periodo").distinct().collect()]
    rows = df.filter(~F.col(month).isin(done)) if done else df
    load = f"{run_id}-{uuid.uuid4().hex}"
    target = f"{path}/data/load={load}"
    laid_out(rows, [month], cluster_by).write.partitionBy(month).parquet(target)
    try:
        written = spark.read.schema(df.schema).parquet(target)
    except AnalysisException:  # nothing to write
        return []
    counts = (
        written.groupBy(F.col(month).cast("string").alias("periodo"))
        .agg(F.count("*").alias("filas"), F.count_distinct("_metadata.file_path").alias("archivos")).collect()
    )
    if not counts:
        return []
    order = (ledger.agg(F.max("orden")).first()[0] or 0) + 1
    entries = [(run_id, r["periodo"], load, r["filas"], r["archivos"], order) for r in counts]
    # One file holds the whole commit: it is there, or it is not.
    spark.createDataFrame(entries, LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    return sorted(r["periodo"] for r in counts)


def read_committed(spark: SparkSession, path: str, schema, month: str = "periodo") -> DataFrame:
    """The rows in force of every month; folders of loads that are not in the ledger are not even listed."""
    in_force = committed(spark, path).select("periodo", "load").collect()  # a row per month
    parts = [f"{path}/data/load={r['load']}/{month}={r['periodo']}" for r in in_force]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*parts).select(*schema.names)
