"""Clustering on several columns at once, by a space-filling curve.

Sorting on (a, b, c) keeps files narrow in ``a`` only. Here every column is first turned into its rank among quantiles of
the column, the bits of the ranks are interleaved, and rows are dealt out and sorted by that number: neighbours on
the curve are near each other in every column, so filters on any of them skip row groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

# Bits of a rank. Finer ranks than there are row groups skip nothing more.
RANK_BITS = 8
# Rows the quantiles of text columns are taken from.
SAMPLE_ROWS = 100_000


def _bounds(df: DataFrame, column: str, cells: int, accuracy: int) -> list:
    """Values that cut a column into about equal cells; bounded by the number of cells."""
    kind = df.schema[column].dataType
    shares = [k / cells for k in range(1, cells)]
    if isinstance(kind, BooleanType):
        return [True]
    if isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        found = df.agg(F.percentile_approx(column, shares, accuracy)).first()[0] or []
        return sorted(set(found))
    # Text has no percentiles: the smallest hashes are a sample of the values, whatever the order of the rows.
    value = F.col(column)
    sample = df.select(value.alias("v"), F.xxhash64(*df.columns).alias("h")).filter(value.isNotNull()).orderBy("h", "v").limit(SAMPLE_ROWS)
    values = F.sort_array(F.collect_list("v"))
    last = F.size("values") - 1
    picks = F.array(*(F.get("values", F.floor(last * s).cast("int")) for s in shares))
    found = sample.agg(values.alias("values")).select(F.array_distinct(F.array_compact(picks))).first()[0]
    return sorted(found, key=lambda v: v.encode()) if found and isinstance(found[0], str) else sorted(found or [])


def rank_in(value: Column, bounds: Sequence) -> Column:
    """How many bounds the value reaches: 0 for NULL. Halving the bounds makes it a search, not a scan."""
    if not bounds:
        return F.lit(0)
    middle = len(bounds) // 2
    above = rank_in(value, bounds[middle + 1:]) + (middle + 1)
    return F.when(value >= F.lit(bounds[middle]), above).otherwise(rank_in(value, bounds[:middle]))


def curve_key(ranks: Sequence[Column], bits: int = RANK_BITS) -> Column:
    """The ranks' bits interleaved, the highest first."""
    key = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for rank in ranks:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(rank.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")))
    return key


def clustered(df: DataFrame, columns: Sequence[str], bits: int = RANK_BITS, accuracy: int = 10_000, files: int | None = None) -> DataFrame:
    """``df`` dealt out and sorted along the curve through ``columns``, ready to be written.

    Give a staged frame: quantiles take a pass per column. Ranges of the curve are balanced by Spark's range partitioning; the
    columns themselves break ties, so a curve cell that holds a large share of the rows is split as well.
    """
    if len(columns) * bits > 62:
        raise ValueError(f"{len(columns)} columns of {bits} bits do not fit into a long")
    bounds = {c: _bounds(df, c, 1 << bits, accuracy) for c in columns}
    ranked = df.withColumns({f"_rank{k}": rank_in(F.col(c), bounds[c]) for k, c in enumerate(columns)})
    keyed = ranked.withColumn("_curve", curve_key([F.col(f"_rank{k}") for k in range(len(columns))], bits))
    order = ["_curve", *columns]
    spread = keyed.repartitionByRange(files, *order) if files else keyed.repartitionByRange(*order)
    return spread.sortWithinPartitions(*order).drop("_curve", *(f"_rank{k}" for k in range(len(columns))))
