"""rank() inside groups that are too large for one task.

``rank().over(partitionBy(month))`` moves a whole month into one task, and a month may hold a
third of the table. Here the rank is a sum of counts instead:

1. Equal values are counted first (map-side combine), which folds ties, however many.
2. The distinct values are cut into cells: by octave (the power of two below the value) and then by
   fixed binary digits of the value within its octave, so every magnitude is cut equally finely.
   Running sums over the counts of cells give each cell its starting rank.
3. A window orders the distinct values inside one cell. Magnitudes must not be negative.
4. The rank of each distinct value is joined back to the rows on (group, value). No later
   operator shares that stage's partitioning, so the adaptive planner may split a hot value.

Cells depend only on the value (scaling by powers of two is exact in binary floating point), not
on samples: a recomputed task after a lost executor sees the same cells.

Rows that are to be gathered by group anyway need no such join: ``rank_slices`` cuts large groups into ranges of values by counts
of cells alone, and ``ranked_in_slices`` ranks rows in the one shuffle that brings each slice together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varcost.functions.joins import join_null_safe
from varcost.sinks.scratch import stage

# Bits of each digit of a value within its octave. A group has at most 2,102 octaves, an octave
# 2**10 cells at the next level, and such a cell 2**16 at the last.
DIGIT_BITS = (10, 16)

# Rows that a task takes of one group at least, before the group is cut.
ROWS_PER_SLICE = 500_000
# Bits of a value within its octave by which slices are cut: the first digit for all, the next only in cells that are too large.
SLICE_BITS = (5, 10, 11)

# Octaves of the values that have none, around those of the doubles (-1074 to 1023).
_NULL, _ZERO, _INFINITE, _NAN = -3000, -2000, 2000, 3000


def _power_of_two(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent.cast("double"))


def _digits(df: DataFrame, score: str, bits: Sequence[int]) -> DataFrame:
    """Add ``_digit0`` (the octave), ``_digit1``, ...; larger scores never have smaller digits."""
    value = F.col(score)
    regular = (value > 0) & (value < float("inf"))
    # The logarithm may be off by one next to a power of two. Scaling by powers of two is exact, so
    # comparing the scaled value with 1 and 2 mends that. Two steps, because 2**1074 is no double.
    guess = F.when(regular, F.floor(F.log2(value)))
    half = F.floor(F.col("_guess") / 2)
    scaled = value * _power_of_two(-half) * _power_of_two(half - F.col("_guess"))
    shift = F.when(F.col("_scaled") >= 2, 1).when(F.col("_scaled") < 1, -1).otherwise(0)
    octave = (
        F.when(F.isnan(value), _NAN).when(value < 0, _NULL).when(value == 0, _ZERO)
        .when(regular, F.col("_guess") + F.col("_shift")).otherwise(_INFINITE)
    )
    df = df.withColumn("_guess", guess).withColumn("_scaled", scaled).withColumn("_shift", shift)
    # The default never applies; it tells the optimiser that digits are never NULL.
    df = df.withColumn("_digit0", F.coalesce(octave.cast("bigint"), F.lit(0).cast("bigint")))
    rest = F.coalesce(F.when(regular, F.col("_scaled") * _power_of_two(-F.col("_shift")) - 1), F.lit(0.0))
    for i, width in enumerate(bits, 1):
        rest = rest * (2.0**width)
        digit = F.floor(rest)
        df = df.withColumn(f"_digit{i}", F.coalesce(digit, F.lit(0).cast("bigint")))
        rest = rest - digit
    return df.drop("_guess", "_scaled", "_shift")


def scored(magnitude: Column) -> Column:
    """The value ranked on: NULL becomes -1, below every magnitude."""
    return F.coalesce(magnitude, F.lit(-1.0))


def magnitude_ranks(
    df: DataFrame,
    group: str,
    magnitude: Column,
    name: str,
    digit_bits: Sequence[int] = DIGIT_BITS,
) -> DataFrame:
    """Rank of each distinct value per group: columns ``group``, ``_score`` and ``name``.

    More or wider digits make cells finer where very many distinct values lie close together;
    the result does not depend on them.
    """
    cells = [f"_digit{i}" for i in range(len(digit_bits) + 1)]
    distinct = df.groupBy(group, scored(magnitude).alias("_score")).agg(F.count("*").alias("_n"))
    # A structure is never NULL, so plain equality joins its NULL groups, keeps the windows'
    # partitioning, and adds no IS NOT NULL filters that would keep branches from sharing shuffles.
    distinct = _digits(distinct, "_score", digit_bits).select(F.struct(group).alias("_group"), *cells, "_score", "_n")

    # Counts of cells, finest first; then the rows above each cell, added up from the coarsest level.
    counts = [distinct.groupBy("_group", *cells).agg(F.sum("_n").alias("_n"))]
    for depth in range(len(cells) - 1, 0, -1):
        counts.append(counts[-1].groupBy("_group", *cells[:depth]).agg(F.sum("_n").alias("_n")))
    starts = None
    for depth, count in enumerate(reversed(counts), 1):
        level = ["_group", *cells[:depth]]
        above = _with_rows_above(count, level[:-1], level[-1]).select(*level, "_above")
        if starts is not None:
            above = above.join(starts, level[:-1]).withColumn("_above", F.col("_above") + F.col("_start"))
        starts = above.select(*level, F.col("_above").alias("_start"))

    # The distinct values move once, by their whole cell, which is small whatever the group.
    ranked = _with_rows_above(distinct, ["_group", *cells], "_score")
    ranked = ranked.join(starts, ["_group", *cells])
    return ranked.select(
        F.col("_group")[group].alias(group), "_score", (F.col("_above") + F.col("_start") + 1).alias(name)
    )


def join_ranks(df: DataFrame, ranks: DataFrame, group: str, magnitude: Column) -> DataFrame:
    """Add the rank of ``magnitude`` to every row of ``df``.

    The value is a join key, not a column of ``df``: it does not travel, only what it is computed from.
    """
    keyed = ranks.withColumnsRenamed({group: f"_right_{group}", "_score": "_right_score"})
    same = df[group].eqNullSafe(keyed[f"_right_{group}"]) & (scored(magnitude) == keyed["_right_score"])
    return df.join(keyed, same, "left").drop(f"_right_{group}", "_right_score")


def _coded(df: DataFrame, score: str, bits: int) -> DataFrame:
    """Add ``_code``: octave and first ``bits`` binary digits of the value as one whole number; larger scores have no smaller code."""
    cut = _digits(df, score, (bits,))
    return cut.withColumn("_code", F.col("_digit0") * 2**bits + F.col("_digit1")).drop("_digit0", "_digit1")


def rank_slices(
    df: DataFrame,
    group: str,
    magnitude: Column,
    rows: int = ROWS_PER_SLICE,
    bits: Sequence[int] = SLICE_BITS,
) -> DataFrame:
    """Ranges of values that cut each group into slices of less than twice ``rows`` rows, with the rows ranked above each.

    Columns: ``group``, ``_low`` and ``_high`` (codes; the range ends before ``_high``, NULL is open), ``_start`` (rows of the
    group above the slice) and ``_parts``. Cells of values are counted map-side, finer ones only inside cells that are too
    large; no row is shuffled. A single value with more rows is a slice of its own; all its rows have one rank, so they
    may be dealt into ``_parts``. Several values closer than the last digit are one slice, however many rows they have.

    The result is staged: as small as it is, joins broadcast it, and every task sees the same ranges.
    """
    width = sum(bits)
    values = df.select(F.col(group), scored(magnitude).alias("_score"))
    coded, found = _coded(values, "_score", width), None
    wanted, shift = coded, width
    for digit in bits:
        shift -= digit
        cell = F.shiftright("_code", shift)
        cells = stage(
            wanted.groupBy(group, cell.alias("_cell")).agg(
                F.count("*").alias("_n"), F.min("_score").alias("_least"), F.max("_score").alias("_most")
            ),
            "cells",
        ).withColumn("_low", F.shiftleft("_cell", shift))
        too_large = (F.col("_n") > rows) & (F.col("_least") < F.col("_most"))
        cut_on = shift > 0 and not cells.filter(too_large).isEmpty()
        kept = cells.filter(~too_large) if cut_on else cells
        found = kept if found is None else found.unionByName(kept)
        if not cut_on:
            break
        large = cells.filter(too_large).select(group, "_cell")
        wanted = join_null_safe(coded.withColumn("_cell", cell), large, [group], "left_semi", never_null=["_cell"]).drop("_cell")

    one_value = F.col("_least") == F.col("_most")
    placed = _with_rows_above(found, [group], "_low").withColumns({
        "_place": F.floor(F.col("_above") / rows),
        # The last of its place, since the next cell has this one's rows above it.
        "_alone": F.col("_n") > rows,
        "_parts": F.when(one_value, F.ceil(F.col("_n") / rows)).otherwise(1),
    })
    slices = placed.groupBy(group, "_place", "_alone").agg(
        F.min("_low").alias("_low"), F.min("_above").alias("_start"), F.when(F.col("_alone"), F.max("_parts")).otherwise(1).alias("_parts")
    )
    upwards = Window.partitionBy(group).orderBy("_low")
    return stage(slices.select(group, "_low", F.lead("_low").over(upwards).alias("_high"), "_start", "_parts"), "slices")


def ranked_in_slices(
    df: DataFrame,
    slices: DataFrame,
    group: str,
    magnitude: Column,
    name: str,
    salt: Sequence[str],
    bits: Sequence[int] = SLICE_BITS,
) -> DataFrame:
    """Add the rank of ``magnitude`` in its group, gathering rows by group and slice: the result of ``rank()``.

    ``slices`` are those of the same rows by :func:`rank_slices` with the same ``bits``. ``salt`` are columns by which rows with one
    very frequent value are dealt out. The value does not travel, only what it is computed from.
    """
    coded = _coded(df.withColumn("_score", scored(magnitude)), "_score", sum(bits)).drop("_score")
    cut = slices.withColumnRenamed(group, f"_right_{group}")
    inside = (
        coded[group].eqNullSafe(cut[f"_right_{group}"]) & (coded["_code"] >= cut["_low"])
        & (cut["_high"].isNull() | (coded["_code"] < cut["_high"]))
    )
    part = F.pmod(F.xxhash64(*salt), F.col("_parts")).cast("int")
    dealt = coded.join(cut, inside, "left").withColumn("_part", part).drop("_code", f"_right_{group}", "_low", "_high", "_parts")
    # No two slices of a group have the same rows above them, so the start names the slice.
    gathered = dealt.repartition(group, "_start", "_part")
    in_slice = Window.partitionBy(group, "_start", "_part").orderBy(scored(magnitude).desc())
    return gathered.withColumn(name, F.col("_start") + F.rank().over(in_slice)).drop("_start", "_part")


def _with_rows_above(counts: DataFrame, partition: Sequence[str], order: str) -> DataFrame:
    """Rows counted before each entry of its partition, in descending order."""
    before = (
        Window.partitionBy(*partition)
        .orderBy(F.col(order).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn("_above", F.coalesce(F.sum("_n").over(before), F.lit(0)))
