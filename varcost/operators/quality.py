"""Declarative data-quality suites: any number of checks, one aggregate, one report frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varcost import constants as K

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"

REPORT_COLUMNS = ("df", "check", "value", "threshold", "status")


class DataQualityError(RuntimeError):
    """A data-quality suite failed."""


@dataclass(frozen=True)
class NullRate:
    """Share of NULLs; more than ``limit`` fails. An empty table passes."""

    column: str
    limit: float = K.MAX_NULL_RATE

    @property
    def name(self) -> str:
        return f"null_rate:{self.column}"

    def measure(self) -> Column:
        return F.coalesce(F.try_divide(F.count_if(F.col(self.column).isNull()), F.count("*")), F.lit(0.0))

    def status(self, value: Column) -> Column:
        return F.when(value <= self.limit, PASS).otherwise(FAIL)


@dataclass(frozen=True)
class Uniqueness:
    """Distinct keys per row; less than ``limit`` warns. NULL counts as one more value.

    Where rows have been tagged, ``repeated`` is true on those whose key other rows have too: only they need to be told apart.
    """

    columns: tuple[str, ...]
    limit: float = K.MIN_UNIQUENESS
    repeated: Column | None = None

    @property
    def name(self) -> str:
        return f"uniqueness:{','.join(self.columns)}"

    def measure(self) -> Column:
        key = F.struct(*self.columns)
        if self.repeated is None:
            distinct = F.count_distinct(key)
        else:
            distinct = F.count_if(~self.repeated) + F.count_distinct(F.when(self.repeated, key))
        return F.coalesce(F.try_divide(distinct, F.count("*")), F.lit(0.0))

    def status(self, value: Column) -> Column:
        return F.when(value >= self.limit, PASS).otherwise(WARN)


@dataclass(frozen=True)
class InRange:
    """Rows outside ``[low, high]``; any one fails. NULL is not counted."""

    column: str
    low: float
    high: float
    limit: float = 0.0

    @property
    def name(self) -> str:
        return f"price_range:{self.column}"

    def measure(self) -> Column:
        value = F.col(self.column)
        return F.count_if((value < self.low) | (value > self.high)).cast("double")

    def status(self, value: Column) -> Column:
        return F.when(value <= self.limit, PASS).otherwise(FAIL)


Check = NullRate | Uniqueness | InRange

CATALOGUE_SUITE: tuple[Check, ...] = (
    NullRate("codigo_sns"),
    NullRate("precio_ref"),
    Uniqueness(("codigo_sns",)),
    InRange("precio_ref", K.MIN_PRICE, K.MAX_PRICE),
)
PROVIDER_SUITE: tuple[Check, ...] = (
    NullRate("prestador_id"),
    NullRate("nombre"),
    Uniqueness(("prestador_id",)),
)
COST_GRAIN = ("prestador_id", "codigo_sns", "periodo")
COST_SUITE: tuple[Check, ...] = (NullRate("costo_real"), NullRate("costo_ppto"), Uniqueness(COST_GRAIN))


def run_suite(df: DataFrame, dataset: str, checks: Sequence[Check]) -> DataFrame:
    """Report with one row per check, from a single aggregate over ``df``.

    A status is decided on the unrounded measure; the reported value has four decimals.
    """
    measured = df.agg(*(c.measure().alias(f"m{i}") for i, c in enumerate(checks)))
    rows = [
        F.struct(
            F.lit(dataset).alias("df"),
            F.lit(c.name).alias("check"),
            F.round(F.col(f"m{i}"), 4).alias("value"),
            F.lit(float(c.limit)).alias("threshold"),
            c.status(F.col(f"m{i}")).alias("status"),
        )
        for i, c in enumerate(checks)
    ]
    return measured.select(F.inline(F.array(*rows)))


def summarise(report: DataFrame) -> DataFrame:
    """Totals and overall status per data set; a warning does not fail it."""
    failed = F.count_if(F.col("status") == FAIL)
    return report.groupBy("df").agg(
        F.count("*").alias("total_checks"),
        failed.alias("failed"),
        F.count_if(F.col("status") == WARN).alias("warned"),
        F.when(failed > 0, FAIL).otherwise(PASS).alias("overall"),
    )


def summaries_with_checks(report: DataFrame, run_ts: str) -> DataFrame:
    """The summary plus its run time and the list of checks, as exported to JSON."""
    checks = report.groupBy("df").agg(
        F.sort_array(F.collect_list(F.struct("check", "value", "threshold", "status"))).alias("checks")
    )
    return summarise(report).join(checks, "df").withColumn("run_ts", F.lit(run_ts))


def collect_summaries(summary: DataFrame) -> list[dict]:
    """The summaries as dictionaries; there is one per data set."""
    return [row.asDict(recursive=True) for row in summary.orderBy("df").collect()]


def gate(summary: DataFrame) -> list[dict]:
    """Return the summaries, or raise if any data set failed."""
    summaries = collect_summaries(summary)
    failed = [f"{s['df']} ({s['failed']} failed checks)" for s in summaries if s["overall"] == FAIL]
    if failed:
        raise DataQualityError(f"data quality failed in {', '.join(failed)}")
    return summaries


def gate_from_report(spark: SparkSession, path: str) -> list[dict]:
    """Apply the gate to a JSON report written by an earlier run."""
    return gate(spark.read.json(path))


def grain_violations(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts."""
    return df.groupBy(*grain).agg(F.count("*").alias("filas")).filter("filas > 1")
