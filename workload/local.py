"""What a session needs before it runs the workload: code on the workers, and a scratch folder.

This is the one place that names machine-local folders: the driver's copy of the code, which Spark
distributes, and a scratch folder for runs in local mode that set none.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ensure_scratch(spark: SparkSession) -> None:
    """Give a session in local mode a scratch folder if ``spark.checkpoint.dir`` is unset."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="varcost-"))


def ship_code(spark: SparkSession) -> None:
    """Send the packages to the Python workers, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="varcost-code-")) / "varcost_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for package in ("varcost", "workload"):
            for path in sorted((ROOT / package).rglob("*.py")):
                out.write(path, path.relative_to(ROOT))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> None:
    ensure_scratch(spark)
    ship_code(spark)
