"""Budget variance: ratio, alert, severity, trend, month rank and provider total."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from varcost import constants as K
from varcost.functions import variance as V
from varcost.functions.joins import join_null_safe
from varcost.operators import scd2
from varcost.operators.ranking import DIGIT_BITS, ROWS_PER_SLICE, join_ranks, magnitude_ranks, rank_slices, ranked_in_slices
from varcost.sinks.scratch import stage


@dataclass(frozen=True)
class VarianceSpec:
    """Column names and thresholds; the defaults fit the cost contract.

    ``rank_digits`` sets how finely a month is cut for ranking. Another level, ``(10, 16, 16)``,
    suits months with a great many different variances within a few parts in 100 million.
    """

    provider: str = "prestador_id"
    item: str = "codigo_sns"
    month: str = "periodo"
    actual: str = "costo_real"
    budget: str = "costo_ppto"
    alert_at: float = K.ALERT_AT
    bands: tuple[tuple[str, float], ...] = K.SEVERITY_BANDS
    rank_digits: tuple[int, ...] = DIGIT_BITS


SPEC = VarianceSpec()

# Rows of one provider that a task takes at least, before the provider's series are dealt out; and the part that a row is in.
ROWS_PER_PART = 500_000
PART = "_provider_part"

# What :func:`budget_variance` adds to the costs.
VARIANCE_COLUMNS = (
    "desvio_pct", "desvio_abs_ars", "alerta_flag", "severidad", "desvio_pct_anterior", "tendencia",
    "costo_real_acum_prestador", "rank_desvio_periodo",
)


def with_ratio(df: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame:
    """Add ``desvio_pct`` and ``desvio_abs_ars``."""
    actual, budget = F.col(spec.actual), F.col(spec.budget)
    return df.withColumns({"desvio_pct": V.ratio(actual, budget), "desvio_abs_ars": actual - budget})


def with_bands(df: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame:
    """Add ``alerta_flag`` and ``severidad`` from ``desvio_pct``."""
    variance = F.col("desvio_pct")
    return df.withColumns({
        "alerta_flag": V.alert(variance, spec.alert_at),
        "severidad": V.severity(variance, spec.bands),
    })


def observed(df: DataFrame, spec: VarianceSpec = SPEC) -> Column:
    """``desvio_pct`` of a row: the column, or where rows travel without it, the ratio of their amounts."""
    return F.col("desvio_pct") if "desvio_pct" in df.columns else V.ratio(F.col(spec.actual), F.col(spec.budget))


def _in_time(spec: VarianceSpec) -> list[Column]:
    return [F.col(spec.month).asc_nulls_first(), F.col(spec.actual), F.col(spec.budget)]


def series_window(df: DataFrame, spec: VarianceSpec) -> WindowSpec:
    """One series in time. A NULL month is the first."""
    # A series is in one part, so naming the part changes nothing but that rows by part need no shuffle.
    parts = [PART] if PART in df.columns else []
    return Window.partitionBy(spec.provider, *parts, spec.item).orderBy(*_in_time(spec))


def with_previous(df: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame:
    """Add ``desvio_pct_anterior``: the variance of the previous row of the same series.

    A series is one provider and drug, with one row per month (the fact's grain), so a window
    partition is no longer than the calendar. Months without a row are skipped, not filled. Rows without ``desvio_pct``
    travel without it, see :func:`observed`.
    """
    series = series_window(df, spec)
    if "desvio_pct" in df.columns:
        previous = F.lag("desvio_pct").over(series)
    else:
        previous = V.ratio(F.lag(spec.actual).over(series), F.lag(spec.budget).over(series))
    return df.withColumn("desvio_pct_anterior", previous)


def with_trend(df: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame:
    """Add ``desvio_pct_anterior`` and ``tendencia``."""
    return with_previous(df, spec).withColumn(
        "tendencia", V.trend(observed(df, spec), F.col("desvio_pct_anterior"))
    )


def month_ranks(df: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame:
    """Rank of each absolute variance within its month, as a table to join."""
    return magnitude_ranks(
        df, spec.month, F.abs("desvio_pct"), "rank_desvio_periodo", spec.rank_digits
    )


def with_month_rank(df: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame:
    """Add ``rank_desvio_periodo``: rows of a month by absolute variance, ties sharing a rank."""
    return join_ranks(df, month_ranks(df, spec), spec.month, F.abs("desvio_pct"))


def provider_totals(df: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame:
    """Actual cost per provider and month.

    Summed map-side, so a provider with a third of the rows is not gathered in one task as a
    window would do.
    """
    return df.groupBy(spec.provider, spec.month).agg(
        V.money_sum(F.col(spec.actual)).alias("costo_real_acum_prestador")
    )


def with_provider_total(df: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame:
    """Add ``costo_real_acum_prestador``: what the provider cost in the row's month."""
    return join_null_safe(df, provider_totals(df, spec), [spec.provider, spec.month])


def with_totals_and_ranks(
    trended: DataFrame, costs: DataFrame, spec: VarianceSpec = SPEC, history: DataFrame | None = None
) -> DataFrame:
    """Add month ranks and provider totals to the rows of ``costs`` as they are in ``trended``.

    Totals and ranks are taken from the costs themselves, so each reads only the columns it
    needs from the scan. ``trended`` needs no column that :func:`with_ratio` and :func:`with_bands` add: every column
    it has goes through both joins, and those are sooner computed than sent. For the provider ``history`` see :func:`with_totals`.
    """
    ranks = month_ranks(with_ratio(costs, spec), spec)
    ranked = join_ranks(trended, ranks, spec.month, F.abs(observed(trended, spec)))
    # Last, so that rows of a provider and month are neighbours: what they share compresses well from here on.
    return with_totals(ranked, costs, spec, history)


def with_totals(
    trended: DataFrame, costs: DataFrame, spec: VarianceSpec = SPEC, history: DataFrame | None = None
) -> DataFrame:
    """Add the provider totals of ``costs`` to its rows as they are in ``trended``.

    With the provider ``history`` rows also get the version in force in their month, as the day it began (``scd2.VERSION_SINCE``), from
    which :func:`scd2.version_key` makes ``prestador_sk``. It is the same for all rows of a provider and month, so it is looked up for
    the totals and no join of the rows is needed for it.
    """
    totals = provider_totals(costs, spec)
    if history is not None:
        versions = scd2.as_of_month(totals, history, spec.provider, spec.month, columns=("fecha_inicio",))
        totals = versions.withColumnRenamed("fecha_inicio", scd2.VERSION_SINCE)
    return join_null_safe(trended, totals, [spec.provider, spec.month])


class ByProvider(NamedTuple):
    """Rows gathered by provider and part, and the providers that have several parts."""

    rows: DataFrame
    large: DataFrame


def by_provider(
    costs: DataFrame, history: DataFrame | None = None, spec: VarianceSpec = SPEC, rows: int = ROWS_PER_PART
) -> ByProvider:
    """Costs gathered by provider, so that one shuffle serves trends, totals and the version in force.

    A provider of more than ``rows`` rows is dealt out in parts by item; a series stays whole. Providers are counted map-side. With
    the ``history`` rows also get the version in force in their month (``scd2.VERSION_SINCE``), as by :func:`with_totals`: a
    provider's few versions come along to each of its parts.
    """
    counted = costs.groupBy(spec.provider).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    large = stage(counted.select(spec.provider, F.ceil(F.col("_n") / rows).alias("_parts")), "large")
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    part = F.pmod(F.xxhash64(spec.item), parts).cast("int")
    dealt = join_null_safe(costs, large, [spec.provider]).withColumn(PART, part).drop("_parts")
    if history is None:
        return ByProvider(dealt.repartition(spec.provider, PART), large)
    known = join_null_safe(scd2.versions_by_key(history, spec.provider), large, [spec.provider])
    each = known.withColumn(PART, F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).drop("_parts")
    gathered = dealt.unionByName(each, allowMissingColumns=True).repartition(spec.provider, PART)
    # In the order of the series, which then need no sort of their own.
    of_part = Window.partitionBy(spec.provider, PART).orderBy(spec.item, *_in_time(spec)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    met = gathered.withColumn("_known", F.first("_versions", ignorenulls=True).over(of_part)).filter("_versions IS NULL")
    since = scd2.since_in_force(F.col("_known"), F.col(spec.month))
    return ByProvider(met.withColumn(scd2.VERSION_SINCE, since).drop("_versions", "_known"), large)


def with_totals_by_provider(
    gathered: DataFrame, costs: DataFrame, large: DataFrame, spec: VarianceSpec = SPEC
) -> DataFrame:
    """Add the provider totals of ``costs`` to its rows as :func:`by_provider` has gathered them, without another shuffle.

    Only the totals of ``large`` providers, whose rows are in several parts, are summed apart and joined.
    """
    in_part = Window.partitionBy(spec.provider, PART, spec.month)
    summed = gathered.withColumn("_total", V.money_sum(F.col(spec.actual), over=in_part))
    whole = stage(provider_totals(join_null_safe(costs, large, [spec.provider], "left_semi"), spec), "totals")
    name = "costo_real_acum_prestador"
    joined = join_null_safe(summed, whole, [spec.provider, spec.month])
    return joined.withColumn(name, F.coalesce(name, "_total")).drop("_total", PART)


def ranked_by_month(
    df: DataFrame, costs: DataFrame, spec: VarianceSpec = SPEC, rows: int = ROWS_PER_SLICE
) -> DataFrame:
    """Add ``rank_desvio_periodo`` to the rows of ``costs`` as they are in ``df``, gathered by month for :func:`write_table`.

    One shuffle both ranks the rows and lays them out. A task holds whole months or slices of a large one, each of about ``rows`` rows.
    ``tendencia``, if there, travels as a number.
    """
    trended = "tendencia" in df.columns
    df = df.withColumn("tendencia", V.trend_code(F.col("tendencia"))) if trended else df
    slices = rank_slices(costs, spec.month, F.abs(observed(costs, spec)), rows)
    salt = (spec.provider, spec.item, spec.actual, spec.budget)
    ranked = ranked_in_slices(df, slices, spec.month, F.abs(observed(df, spec)), "rank_desvio_periodo", salt)
    return ranked.withColumn("tendencia", V.trend_label(F.col("tendencia"))) if trended else ranked


def narrow_variance(
    costs: DataFrame, spec: VarianceSpec = SPEC, history: DataFrame | None = None, ranked: bool = True
) -> DataFrame:
    """Costs with the variance columns that take more than the row itself; the rest comes from ratio and bands.

    Not ``ranked`` is for staged costs that :func:`ranked_by_month` ranks as it gathers them; here they are gathered by provider.
    """
    if ranked:
        return with_totals_and_ranks(with_trend(costs, spec), costs, spec, history)
    gathered = by_provider(costs, history, spec)
    return with_totals_by_provider(with_trend(gathered.rows, spec), costs, gathered.large, spec)


def budget_variance(costs: DataFrame, spec: VarianceSpec = SPEC, history: DataFrame | None = None) -> DataFrame:
    """Every variance column of the fact, of costs that hold the whole series.

    With the provider ``history`` also ``prestador_sk``, see :func:`with_totals`.
    """
    whole = with_bands(with_ratio(narrow_variance(costs, spec, history), spec), spec)
    if history is not None:
        whole = whole.withColumn("prestador_sk", scd2.version_key(spec.provider, scd2.VERSION_SINCE))
    return whole.select(*costs.columns, *VARIANCE_COLUMNS, *([] if history is None else ["prestador_sk"]))


def active_alerts(variance: DataFrame) -> DataFrame:
    """Rows whose variance reaches the alert threshold."""
    return variance.filter("alerta_flag")
