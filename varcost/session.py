"""Spark session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffles at run time: it starts from many small partitions, merges
# them to the advisory size, and splits skewed ones. Cluster sizes belong to spark-submit.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A shuffled join whose measured partitions are all this small hashes instead of sorting.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(app_name: str = "varcost", conf: dict[str, str] | None = None) -> SparkSession:
    """Create or reuse the session; ``conf`` overrides the defaults."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
