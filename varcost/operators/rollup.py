"""Distinct counts that can be added up: bitmaps of dense ids per month, merged to quarters and years.

A distinct count per month says nothing about the quarter. A month's *state* is the bitmaps of the providers it has, in
buckets of 32,768 ids; states of any months are merged by OR, so longer periods never read the fact again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varcost.functions.joins import join_null_safe
from varcost.sinks.scratch import stage


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """``column, id``: the distinct values that are not NULL, numbered from 0 without gaps.

    Values are sorted into ranges, one task and file each; a value's number is its row in the file and the rows of the
    files before. Only the count of each file comes to the driver.
    """
    spark = values.sparkSession
    distinct = values.select(column).filter(F.col(column).isNotNull()).distinct()
    ranges = stage(distinct, "values").repartitionByRange(column).sortWithinPartitions(column)
    parts = stage(ranges.withColumn("_part", F.spark_partition_id()), "ranges").withColumn("_row", F.col("_metadata.row_index"))
    before, offsets = 0, []
    for part, n in sorted(map(tuple, parts.groupBy("_part").count().collect())):
        offsets.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))  # a row per task
    return parts.join(starts, "_part").select(column, (F.col("_before") + F.col("_row")).alias("id"))


def distinct_states(df: DataFrame, keys: Sequence[str], column: str, ids: DataFrame) -> DataFrame:
    """``keys, bucket, bits``: the bitmaps of the ids of ``column`` that occur with the keys.

    Distinct pairs are formed map-side first, so a hot month sends each provider once per task.
    """
    pairs = df.select(*keys, column).filter(F.col(column).isNotNull()).distinct()
    numbered = pairs.join(ids, column)
    return numbered.groupBy(*keys, F.expr("bitmap_bucket_number(id)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias("bits")
    )


def merged_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of coarser keys, which ``states`` must have as columns."""
    return states.groupBy(*keys, "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def distinct_counts(states: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Exact distinct counts of the states' keys."""
    return states.groupBy(*keys).agg(F.sum(F.expr("bitmap_count(bits)")).alias(name))


def period_rollup(states: DataFrame, months: DataFrame) -> DataFrame:
    """``nivel, periodo, prestadores``: distinct providers per month, quarter and year, from the months' states alone.

    ``states`` has ``periodo_id``; ``months`` is the calendar. A month that the calendar lacks counts as a month only.
    """
    calendar = months.select("periodo_id", F.col("anio").cast("string").alias("anio"), F.col("trimestre").cast("string").alias("trimestre"))
    dated = stage(join_null_safe(states, calendar, ["periodo_id"]), "states")
    quarters = stage(merged_states(dated.filter("anio IS NOT NULL"), ["anio", "trimestre"]), "quarters")
    years = merged_states(quarters, ["anio"])

    def level(name: str, frame: DataFrame, keys: Sequence[str], label) -> DataFrame:
        return distinct_counts(frame, keys, "prestadores").select(F.lit(name).alias("nivel"), label.alias("periodo"), "prestadores")

    return (
        level("mes", dated, ["periodo_id"], F.col("periodo_id"))
        .unionByName(level("trimestre", quarters, ["anio", "trimestre"], F.concat("anio", F.lit("T"), "trimestre")))
        .unionByName(level("anio", years, ["anio"], F.col("anio")))
    )
