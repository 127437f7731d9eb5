"""A type-2 dimension kept in key-hashed buckets, of which a run rewrites only those that change.

A snapshot touches few keys, but a dimension written as one version is rewritten whole. Here every key lives in the
bucket of its hash; the merge looks at all current versions, finds the buckets whose keys begin or end a version, and replaces
just their folders. Merging a snapshot again changes nothing, so a run that broke after some buckets is simply repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from varcost.operators import scd2
from varcost.sinks.scratch import stage

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a key; NULL is a key like any other."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(buckets)).cast("int")


def read_bucketed(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The dimension, with the ``bucket`` of each row; None if there is none yet. ``schema`` is without it."""
    try:
        return spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _write(rows: DataFrame, path: str) -> None:
    # One folder and one file a bucket; a rewritten bucket's folder is swapped in when the job commits.
    rows.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


def merge_bucketed(
    snapshot: DataFrame,
    path: str,
    on: date,
    key: str = "prestador_id",
    tracked: Sequence[str] = scd2.PROVIDER_TRACKED,
    carried: Sequence[str] = (),
    sk: str = "prestador_sk",
    new_since: date | None = None,
    buckets: int = BUCKETS,
) -> list[int]:
    """Merge a full snapshot into the dimension at ``path``; returns the buckets that were rewritten.

    The number of buckets is that of the first merge. What to rewrite is known from the keys and tracked columns alone; the rows of
    the other buckets are neither merged nor written.
    """
    spark = snapshot.sparkSession
    first = scd2.history({new_since or on: snapshot}, key, tracked, carried, sk)
    known = read_bucketed(spark, path, first.schema)
    if known is None:
        _write(first.withColumn("bucket", bucket_of(key, buckets)), path)
        return list(range(buckets))
    state = F.struct(*tracked)
    old = known.filter("es_vigente").select(F.col(key).alias("_key"), state.alias("_old"), F.col("bucket").alias("_bucket"))
    new = snapshot.select(F.col(key).alias("_new_key"), state.alias("_new"), bucket_of(key, buckets).alias("_new_bucket"))
    both = old.withColumn("_has_old", F.lit(True)).join(
        new.withColumn("_has_new", F.lit(True)), F.col("_key").eqNullSafe(F.col("_new_key")), "full"
    )
    changed = both.filter(
        F.col("_has_old").isNull() | F.col("_has_new").isNull() | ~F.col("_old").eqNullSafe(F.col("_new"))
    ).select(F.coalesce("_bucket", "_new_bucket").alias("bucket"))
    touched = sorted(r[0] for r in changed.distinct().collect())  # at most the number of buckets
    if not touched:
        return []
    part = known.filter(F.col("bucket").isin(touched)).drop("bucket")
    incoming = snapshot.withColumn("_b", bucket_of(key, buckets)).filter(F.col("_b").isin(touched)).drop("_b")
    merged = scd2.merge_snapshot(part, incoming, on, key, tracked, carried, sk, new_since)
    # Staged, because the folders that are replaced are those that are read.
    _write(stage(merged.withColumn("bucket", bucket_of(key, buckets)), "buckets"), path)
    return touched
