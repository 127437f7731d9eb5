"""Trends over monthly loads: the last observation of every series is carried from load to load.

A series is a provider and a drug. The *carry* table holds, per series, the month and variance of its last row, so a load
of new months reads the carry and its own rows, not the history. If a month is loaded again, the
carry is too new for it; then the rows from that month on are looked up in the history, and rows that now follow
another variance get their trend anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varcost.functions import variance as V
from varcost.functions.joins import join_null_safe
from varcost.operators.variance import SPEC, VarianceSpec, observed, series_window, with_previous

LAST = "_last"


def _place(spec: VarianceSpec) -> Column:
    """Order of the rows of a series; a NULL month is the first."""
    return F.struct(F.col(spec.month).isNotNull().alias("known"), spec.month, spec.actual, spec.budget)


def _observed(spec: VarianceSpec) -> list[str]:
    return [spec.provider, spec.item, spec.month, spec.actual, spec.budget, "desvio_pct"]


def last_observations(df: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame:
    """The carry table of some rows: per series the month, amounts and variance of its last one.

    One aggregate that combines map-side. Rows without ``desvio_pct`` have the ratio of their amounts, taken of the last ones alone.
    """
    # The variance is last, so it only decides between rows that are alike in all else, the same on every run.
    given = [c for c in ("desvio_pct",) if c in df.columns]
    last = F.struct(F.col(spec.month).isNotNull().alias("_known"), spec.month, spec.actual, spec.budget, *given)
    found = df.groupBy(spec.provider, spec.item).agg(F.max(last).alias("last"))
    lasts = found.select(spec.provider, spec.item, "last.*").drop("_known")
    return lasts if given else lasts.withColumn("desvio_pct", observed(lasts, spec))


def with_last(df: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame:
    """Add ``_last``: whether the row is the last of its series, in the order of :func:`with_previous`."""
    return df.withColumn(LAST, F.lead(F.lit(True)).over(series_window(df, spec)).isNull())


def carry_of_last(df: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame:
    """The carry table of rows with ``_last``: the same as :func:`last_observations`."""
    lasts = df.filter(LAST)
    return lasts.withColumn("desvio_pct", observed(lasts, spec)).select(*_observed(spec))


def merged_carry(carry: DataFrame | None, df: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame:
    """The carry after a load: the later of the two last rows of each series."""
    if carry is None:
        return last_observations(df, spec)
    new = df.withColumn("desvio_pct", observed(df, spec)).select(*_observed(spec))
    return last_observations(carry.select(*_observed(spec)).unionByName(new), spec)


def carry_before(history: DataFrame, month: str, spec: VarianceSpec = SPEC) -> DataFrame:
    """The carry as it was before a month, from the rows loaded so far; later partitions of the table are not read."""
    return last_observations(history.filter(F.col(spec.month) < month), spec)


def with_carried_previous(df: DataFrame, carry: DataFrame | None, spec: VarianceSpec = SPEC) -> DataFrame:
    """Add ``desvio_pct_anterior``: as :func:`with_previous`, where the first row of a series follows the carried one.

    The carry must be older than all rows of ``df``.
    """
    if carry is None:
        return with_previous(df, spec)
    series = [spec.provider, spec.item]
    # Only the first rows of series meet the carry; the others have the row before them here.
    firsts = df.groupBy(*series).agg(F.min(_place(spec)).alias("_first"))
    carried = join_null_safe(firsts, carry.select(*series, F.col("desvio_pct").alias("_carried")), series, how="inner")
    followed = join_null_safe(with_previous(df, spec), carried, series)
    first = F.col("_first").eqNullSafe(_place(spec)) & F.col("_first").isNotNull()
    return followed.withColumn(
        "desvio_pct_anterior", F.when(first, F.col("_carried")).otherwise(F.col("desvio_pct_anterior"))
    ).drop("_first", "_carried")


def with_carried_trend(df: DataFrame, carry: DataFrame | None, spec: VarianceSpec = SPEC) -> DataFrame:
    """Add ``desvio_pct_anterior`` and ``tendencia`` after a carry."""
    return with_carried_previous(df, carry, spec).withColumn(
        "tendencia", V.trend(observed(df, spec), F.col("desvio_pct_anterior"))
    )


def reloaded_trends(
    history: DataFrame, rows: DataFrame, months: Sequence[str], spec: VarianceSpec = SPEC
) -> tuple[DataFrame, DataFrame]:
    """What a load of months that are not the newest means: the trends of its rows, and those of later rows that change.

    ``history`` holds what was loaded before, with ``tendencia``; its rows of the reloaded ``months`` no longer count. The first result
    has all columns of ``rows``, the second those of a series, and both ``desvio_pct_anterior`` and ``tendencia``. Rows before the
    first of the months are only aggregated to the carry.
    """
    first = min(months)
    later = history.filter((F.col(spec.month) >= first) & ~F.col(spec.month).isin(*months))
    columns = _observed(spec)
    was = later.select(*columns, F.col("tendencia").alias("_was"))
    new = rows.withColumn("_was", F.lit(None).cast("string"))
    trended = with_carried_trend(new.unionByName(was, allowMissingColumns=True), carry_before(history, first, spec), spec)
    corrected = trended.filter(F.col("_was") != F.col("tendencia")).select(*columns, "desvio_pct_anterior", "tendencia")
    return trended.filter("_was IS NULL").drop("_was"), corrected
