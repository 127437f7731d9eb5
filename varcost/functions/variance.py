"""The variance metric: ratio, alert, severity and trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from varcost import constants as K

# Sums of it are the warehouse's NUMERIC, decimal(38,9).
MONEY = "decimal(29,9)"


def ratio(actual: Column, budget: Column) -> Column:
    """(actual - budget) / budget; NULL unless the budget is positive."""
    return F.when(budget > 0, (actual - budget) / budget)


def alert(variance: Column, at: float = K.ALERT_AT) -> Column:
    """Whether the variance reaches the threshold either way; NULL without a variance."""
    return F.abs(variance) >= at


def severity(variance: Column, bands: Sequence[tuple[str, float]] = K.SEVERITY_BANDS) -> Column:
    """Label of the highest band the absolute variance reaches (bounds are inclusive)."""
    branches = F
    for label, lower in bands:
        branches = branches.when(F.abs(variance) >= lower, F.lit(label))
    return branches.otherwise(K.SEVERITY_NONE)


def trend(current: Column, previous: Column) -> Column:
    """Direction against the previous observation.

    Without a previous value the row counts as new; a missing current value counts as stable.
    """
    return (
        F.when(previous.isNull(), K.TREND_NEW)
        .when(current > previous, K.TREND_WORSE)
        .when(current < previous, K.TREND_BETTER)
        .otherwise(K.TREND_SAME)
    )


TRENDS = (K.TREND_NEW, K.TREND_WORSE, K.TREND_BETTER, K.TREND_SAME)


def trend_code(label: Column) -> Column:
    """A trend as a small number, for rows that travel; :func:`trend_label` is its inverse."""
    branches = F
    for code, name in enumerate(TRENDS):
        branches = branches.when(label == name, F.lit(code))
    return branches.cast("tinyint")


def trend_label(code: Column) -> Column:
    branches = F
    for known, name in enumerate(TRENDS):
        branches = branches.when(code == known, F.lit(name))
    return branches


def money_sum(amount: Column, over: WindowSpec | None = None) -> Column:
    """Sum of a double amount that does not depend on the order rows arrive in; ``over`` a window, if one is given.

    Decimals cannot hold NaN or infinity, so those are summed apart and outweigh the rest, as in
    a sum of doubles. An amount too large for the decimal is an error.
    """
    value = amount.cast("double")
    not_finite, finite = F.sum(F.when(F.isnan(value - value), value)), F.sum(amount.cast(MONEY))
    if over is not None:
        not_finite, finite = not_finite.over(over), finite.over(over)
    return F.coalesce(not_finite, finite.cast("double"))


def ratio_of_sums(part: Column, whole: Column) -> Column:
    """sum(part) / sum(whole); NULL when the total is zero."""
    return F.try_divide(money_sum(part), money_sum(whole))
