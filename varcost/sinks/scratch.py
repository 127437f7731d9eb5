"""Intermediate tables in the cluster's shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or set as the context's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result that several branches of a plan read, and scan it.

    Each branch then reads only its own columns from Parquet instead of repeating the shuffles
    behind ``df``, and a lost executor costs a re-read, not a recomputation from the sources.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
