"""The version in force at a row's time, by merging both in time order.

A hash join on the key compares a row with every version of its key, which is right for a provider with a few versions. For
keys with very many versions, rows and versions are put in one frame sorted by key and time, and the last version
is carried down by a window. To keep a hot key out of one task, time is cut into ranges: a window runs inside one
(key, range), and the version in force at a range's beginning is carried over from the last range that has one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Months that one range of time holds.
RANGE_MONTHS = 12


def _range_of(month: Column, months: int) -> Column:
    """The range of a ``yyyyMM`` month; NULL before all others."""
    whole = F.substring(month, 1, 4).try_cast("int") * 12 + F.substring(month, 5, 2).try_cast("int") - 1
    return F.coalesce(F.floor(whole / months), F.lit(-1))


def as_of_month_merge(
    fact: DataFrame,
    dimension: DataFrame,
    key: str = "prestador_id",
    month: str = "periodo",
    columns: Sequence[str] = ("prestador_sk",),
    range_months: int = RANGE_MONTHS,
    salt: int = 1,
) -> DataFrame:
    """The same rows as :func:`scd2.as_of_month`: each fact row with the version in force on the last day of its month.

    Versions of a key must not overlap. A version counts from the month it begins in; of versions that begin in the same month
    the last is in force at its end. ``salt`` splits the rows of one key and range further: fact rows are spread over that many
    copies of the range's versions, so a provider with a third of the rows is cut into ``salt`` parts per range.
    """
    carried = F.struct(*(F.col(c) for c in columns))
    begin, end = F.date_format("fecha_inicio", "yyyyMM"), F.date_format("fecha_fin", "yyyyMM")
    versions = dimension.select(
        F.col(key).alias("_key"), begin.alias("_month"), F.struct(F.col("fecha_inicio").alias("since"), end.alias("until"), carried.alias("row")).alias("_version"),
    ).withColumn("_range", _range_of(F.col("_month"), range_months))

    # The last version that begins in each range, and with it the one in force when a later range begins. A key has no
    # more entries than ranges of time.
    last = versions.groupBy("_key", "_range").agg(F.max_by("_version", "_version.since").alias("_last"))
    rows = fact.withColumn("_range", _range_of(F.col(month), range_months)).withColumn("_salt", _spread(fact, salt))
    wanted = rows.select(F.col(key).alias("_key"), "_range").distinct()
    marks = wanted.withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType)).unionByName(last).groupBy("_key", "_range").agg(
        F.max_by("_last", "_last.since").alias("_last")
    )
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    openings = marks.withColumn("_opening", F.last("_last", ignorenulls=True).over(earlier)).filter("_opening IS NOT NULL")

    # Everything of a range in time order: what was in force before, the versions that begin in it, the fact's rows.
    empty = F.lit(None).cast(versions.schema["_version"].dataType)
    fact_row = F.struct(*(F.col(c) for c in fact.columns))
    salts = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
    parts = [
        openings.select("_key", "_range", salts.alias("_salt"), F.lit("").alias("_month"), F.lit(0).alias("_kind"), F.col("_opening").alias("_version")),
        versions.select("_key", "_range", salts.alias("_salt"), "_month", F.lit(1).alias("_kind"), "_version"),
    ]
    merged = rows.select(
        F.col(key).alias("_key"), "_range", "_salt", F.col(month).alias("_month"), F.lit(2).alias("_kind"), empty.alias("_version"), fact_row.alias("_fact"),
    )
    for part in parts:
        merged = merged.unionByName(part.withColumn("_fact", F.lit(None).cast(merged.schema["_fact"].dataType)))
    in_time = (
        Window.partitionBy("_key", "_range", "_salt")
        .orderBy(F.col("_month").asc_nulls_first(), "_kind", F.col("_version.since").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = merged.withColumn("_now", F.last("_version", ignorenulls=True).over(in_time)).filter("_kind = 2")
    until = F.col("_now")["until"]
    in_force = F.col("_fact")[key].isNotNull() & F.col("_fact")[month].isNotNull() & (until.isNull() | (until > F.col("_fact")[month]))
    return found.select("_fact.*", *(F.when(in_force, F.col("_now")["row"][c]).alias(c) for c in columns))


def _spread(fact: DataFrame, salt: int) -> Column:
    """A part for each row, by its content, so that a recomputed task deals alike."""
    return F.pmod(F.xxhash64(*fact.columns), F.lit(salt)).cast("int") if salt > 1 else F.lit(0)
