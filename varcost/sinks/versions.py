"""Tables kept as whole versions, each in its own subfolder.

A table that is computed from itself cannot overwrite the files it reads. Here every write adds a
version and none is ever replaced, so a failed write leaves the previous version in force.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from varcost.sinks.writers import laid_out


def versions(spark: SparkSession, path: str) -> list[str]:
    """The names of all versions, oldest first, from the listing of committed files; no file is opened but for one footer."""
    try:
        files = spark.read.parquet(path).inputFiles()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return []
        raise
    return sorted({unquote(name) for f in files for name in re.findall(r"/version=([^/]*)/[^/]*$", unquote(f))})


def version_path(path: str, version: str) -> str:
    return f"{path}/version={version}"


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version, or None if there is none. Other versions are not read."""
    found = versions(spark, path)
    return spark.read.parquet(version_path(path, found[-1])) if found else None


def write_version(df: DataFrame, path: str, run_id: str, cluster_by: Sequence[str] = ()) -> str:
    """Add a version named after the run and the attempt; later names sort last."""
    attempt = sum(v.startswith(f"{run_id}-") for v in versions(df.sparkSession, path))
    version = f"{run_id}-{attempt:04d}"
    laid_out(df, cluster_by=cluster_by).write.parquet(version_path(path, version))
    return version
