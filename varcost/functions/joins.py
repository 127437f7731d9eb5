"""Joins that keep NULL keys together, as a window partition does."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def join_null_safe(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    never_null: Sequence[str] = (),
) -> DataFrame:
    """Equi-join on ``keys`` where NULL meets NULL; the right keys are dropped.

    Spark still hashes or sorts on the keys: ``<=>`` is an equi-join condition, only one that
    compares an extra null flag, which keys in ``never_null`` do without. No side is hinted: the
    adaptive planner broadcasts one only after measuring it, and otherwise splits skewed
    partitions of the shuffled join.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in (*keys, *never_null)})
    same = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    same += [left[k] == renamed[f"_right_{k}"] for k in never_null]
    joined = left.join(renamed, reduce(lambda a, b: a & b, same), how)
    return joined.drop(*(f"_right_{k}" for k in (*keys, *never_null)))
