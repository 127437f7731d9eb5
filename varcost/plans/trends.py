"""A table of observations and trends that is loaded month by month."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varcost.functions.joins import join_null_safe
from varcost.operators import carry as C
from varcost.operators.variance import SPEC, VarianceSpec, by_provider, with_ratio, with_totals_by_provider, with_trend
from varcost.sinks.scratch import stage
from varcost.sinks.versions import read_latest, write_version
from varcost.sinks.writers import write_table


class TrendLoad(NamedTuple):
    """Trends of a load's rows, of earlier loaded rows that it changes, and the carry after it."""

    rows: DataFrame
    corrected: DataFrame | None
    carry: DataFrame


def trend_load(
    rows: DataFrame, history: DataFrame | None, carry: DataFrame | None, spec: VarianceSpec = SPEC
) -> TrendLoad:
    """Trends of ``rows``, with all their columns, after what was loaded before; months are not NULL.

    Rows without ``desvio_pct`` have the ratio of their amounts, which then does not travel with new months.

    Months newer than the carry read nothing but the carry. Otherwise the history is read from the first of them on, and its columns
    that trends need before it. A load has few months; they come to the driver.
    """
    columns = [spec.provider, spec.item, spec.month, spec.actual, spec.budget, "desvio_pct"]
    newest = carry.agg(F.max(spec.month)).first()[0] if carry is not None else None
    months = [] if newest is None else sorted(r[0] for r in rows.select(spec.month).distinct().collect() if r[0] is not None)
    if not months or months[0] > newest:
        return TrendLoad(C.with_carried_trend(rows, carry, spec), None, C.merged_carry(carry, rows, spec))
    if history is None:
        raise ValueError(f"{months[0]} is not newer than {newest}: loading it again needs the history")
    scored = rows if "desvio_pct" in rows.columns else with_ratio(rows, spec).drop("desvio_abs_ars")
    ours, others = C.reloaded_trends(history, scored, months, spec)
    kept = history.filter(~F.col(spec.month).isin(*months)).select(*columns)
    # A series may have lost its last row, so the carry is built anew, from one aggregate over the history's few columns.
    return TrendLoad(ours, others, C.last_observations(kept.unionByName(scored.select(*columns)), spec))


def first_load(costs: DataFrame, providers: DataFrame, spec: VarianceSpec = SPEC) -> TrendLoad:
    """Trends of a load that follows nothing, with provider totals and the versions of ``providers`` in force.

    It needs its series whole, so one shuffle by provider serves them all, see :func:`by_provider`. The result is staged: the carry is
    its last row of each series, which needs no aggregate over all rows.
    """
    gathered = by_provider(costs, providers, spec)
    trended = C.with_last(with_trend(gathered.rows, spec).drop("desvio_pct_anterior"), spec)
    rows = stage(with_totals_by_provider(trended, costs, gathered.large, spec), "trends")
    return TrendLoad(rows.drop(C.LAST), None, C.carry_of_last(rows, spec))


def corrected_months(table: DataFrame, corrected: DataFrame, spec: VarianceSpec = SPEC) -> DataFrame | None:
    """The months of ``table`` that have corrected rows, whole, with their trends anew; None if there are none."""
    fixes = stage(corrected.select(spec.provider, spec.item, spec.month, F.col("tendencia").alias("_new")), "corrected")
    months = [r[0] for r in fixes.select(spec.month).distinct().collect()]
    if not months:
        return None
    whole = join_null_safe(table.filter(F.col(spec.month).isin(*months)), fixes, [spec.provider, spec.item, spec.month])
    return whole.withColumn("tendencia", F.coalesce("_new", "tendencia")).drop("_new").select(*table.columns)


def read_trends(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(f"{path}/observaciones")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_trends(rows: DataFrame, path: str, run_id: str, spec: VarianceSpec = SPEC) -> DataFrame:
    """Load months into the trend table at ``path`` and return the table.

    Its months are partitions; a load replaces its own and those it corrects, and writes a new version of the carry. A load that broke
    can be repeated: its months count as reloaded then.
    """
    spark = rows.sparkSession
    columns = [spec.provider, spec.item, spec.month, spec.actual, spec.budget, "desvio_pct"]
    observed = stage(rows.select(*columns), "load")
    schema = observed.withColumn("tendencia", F.lit("")).schema
    history = read_trends(spark, path, schema)
    load = trend_load(observed, history, read_latest(spark, f"{path}/carry"), spec)
    new = load.rows.select(*columns, "tendencia")
    if load.corrected is not None:
        fixed = corrected_months(history, load.corrected, spec)
        new = new if fixed is None else new.unionByName(fixed)
        new = stage(new, "trends")  # months are replaced that are read
    # Only a reload's carry reads the months that are replaced next.
    carry = load.carry if load.corrected is None else stage(load.carry, "carry")
    write_table(new, f"{path}/observaciones", partition_by=[spec.month], cluster_by=[spec.provider])
    write_version(carry, f"{path}/carry", run_id)
    return read_trends(spark, path, schema)
