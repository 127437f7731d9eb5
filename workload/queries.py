"""One query per operator, over the given tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType

from varcost.contracts import CATALOGUE, COSTS, FACT, WAREHOUSE, enforce_contract, null_violations
from varcost.functions.keys import surrogate_key
from varcost.operators import cleaning, quality, scd2, star, variance
from varcost.plans import audit, marts
from varcost.plans.monthly import run_monthly
from varcost.sinks.scratch import scratch_folder, stage
from varcost.sinks.writers import append_audit, write_report_json, write_spec, write_table
from varcost.sources.calendar import calendar_of
from varcost.sources.readers import read_csv
from workload import adapters as A
from workload.loads import QUERIES as LOAD_QUERIES

GRAIN = ("prestador_id", "periodo", "codigo_sns")
AUDIT = "df string, check string, value double, threshold double, status string, run_id string"
RUN = star.Run(datetime(2002, 1, 1))


def comparable(df: DataFrame) -> DataFrame:
    """Dates as text and decimals as doubles, which both engines print alike."""
    return df.select(*(
        F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, DateType)
        else F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
        else F.col(f.name)
        for f in df.schema
    ))


# Inputs ------------------------------------------------------------------------------------


def staged_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs for the operators that read them in several branches."""
    return stage(A.costs(spark, sf_dir), "costs")


def scored(spark, sf_dir):
    return variance.with_ratio(A.costs(spark, sf_dir))


def banded(spark, sf_dir):
    return variance.with_bands(scored(spark, sf_dir))


def trended(spark, sf_dir):
    """The fact columns the summaries read; they need neither ranks nor totals."""
    return variance.with_trend(banded(spark, sf_dir)).withColumn("periodo_id", F.col("periodo"))


def full(spark, sf_dir, history=None):
    return variance.budget_variance(staged_costs(spark, sf_dir), history=history)


# Dimensions come from a table, as in the monthly run: the planner then knows their size and
# broadcasts a small one without shuffling the fact first.


def staged_catalogue(spark, sf_dir):
    return stage(catalogue(spark, sf_dir), "catalogue")


def staged_providers(spark, sf_dir):
    return stage(providers(spark, sf_dir), "providers")


def staged_history(spark, sf_dir):
    return stage(provider_history(spark, sf_dir), "history")


def catalogue(spark, sf_dir):
    return cleaning.clean_catalogue(A.raw_catalogue(spark, sf_dir), ["p_partkey"])


def providers(spark, sf_dir):
    return cleaning.clean_providers(A.raw_providers(spark, sf_dir), ["ver"])


def months(spark, sf_dir):
    return calendar_of(A.table(spark, sf_dir, "lineitem"), F.col("l_shipdate"))


def provider_history(spark, sf_dir):
    return scd2.history(A.provider_snapshots(spark, sf_dir))


# Variance ----------------------------------------------------------------------------------


def variance_pct(spark, sf_dir):
    return scored(spark, sf_dir).select(*GRAIN, "costo_real", "costo_ppto", "desvio_pct", "desvio_abs_ars")


def variance_alert(spark, sf_dir):
    return banded(spark, sf_dir).select(*GRAIN, "desvio_pct", "alerta_flag")


def severity_bands(spark, sf_dir):
    return banded(spark, sf_dir).select(*GRAIN, "desvio_pct", "severidad")


def variance_lag(spark, sf_dir):
    return variance.with_previous(scored(spark, sf_dir)).select(*GRAIN, "desvio_pct", "desvio_pct_anterior")


def trend(spark, sf_dir):
    return variance.with_trend(scored(spark, sf_dir)).select(*GRAIN, "desvio_pct_anterior", "tendencia")


def variance_rank(spark, sf_dir):
    rows = variance.with_ratio(staged_costs(spark, sf_dir))
    return variance.with_month_rank(rows).select(*GRAIN, "desvio_pct", "rank_desvio_periodo")


def provider_month_total(spark, sf_dir):
    rows = staged_costs(spark, sf_dir)
    return variance.with_provider_total(rows).select(*GRAIN, "costo_real", "costo_real_acum_prestador")


def variance_full(spark, sf_dir):
    return full(spark, sf_dir)


def active_alerts(spark, sf_dir):
    return variance.active_alerts(trended(spark, sf_dir)).select(
        *GRAIN, "costo_real", "costo_ppto", "desvio_pct", "severidad", "tendencia"
    )


# Contracts and cleaning --------------------------------------------------------------------


def scan_contract(spark, sf_dir):
    return enforce_contract(A.raw_catalogue(spark, sf_dir), CATALOGUE).withColumn(
        "fecha_vigencia", F.col("fecha_vigencia").cast("date").cast("string")
    )


def contract_nulls(spark, sf_dir):
    return null_violations(A.costs(spark, sf_dir), COSTS)


def csv_seed(spark, sf_dir):
    """Costs through a CSV file and back under the contract."""
    path = f"{scratch_folder(spark)}/csv-{uuid.uuid4().hex}"
    A.costs(spark, sf_dir).write.option("header", True).csv(path)
    return read_csv(spark, path, COSTS)


def latest_per_key(spark, sf_dir):
    rows = A.raw_catalogue(spark, sf_dir).withColumn("codigo_sns", F.trim(F.upper("codigo_sns")))
    latest = cleaning.latest_per_key(rows, ["codigo_sns"], ["fecha_vigencia", "p_partkey"])
    return latest.select("codigo_sns", "p_partkey", "precio_ref", "vigente")


def dedup_providers(spark, sf_dir):
    return cleaning.dedup_providers(A.raw_providers(spark, sf_dir), ["ver"])


def clean_catalog(spark, sf_dir):
    rows = catalogue(spark, sf_dir).withColumn("fecha_vigencia", F.col("fecha_vigencia").cast("date"))
    return comparable(rows.drop("_ingestion_ts"))


def clean_providers(spark, sf_dir):
    return providers(spark, sf_dir).drop("_ingestion_ts")


# Data quality ------------------------------------------------------------------------------


def dq_null_rate(spark, sf_dir):
    checks = [quality.NullRate(c) for c in ("codigo_sns", "laboratorio", "unidad_medida", "precio_ref")]
    return quality.run_suite(A.raw_catalogue(spark, sf_dir), "catalogue_raw", checks)


def dq_uniqueness(spark, sf_dir):
    raw = quality.run_suite(
        A.raw_providers(spark, sf_dir), "providers_raw", [quality.Uniqueness(("prestador_id",))]
    )
    clean = quality.run_suite(
        providers(spark, sf_dir), "providers_clean", [quality.Uniqueness(("prestador_id",))]
    )
    return raw.unionByName(clean)


def dq_range(spark, sf_dir):
    check = [quality.InRange("precio_ref", 0.01, 500_000.0)]
    raw = quality.run_suite(A.raw_catalogue(spark, sf_dir), "catalogue_raw", check)
    return raw.unionByName(quality.run_suite(catalogue(spark, sf_dir), "catalogue_clean", check))


def dq_catalog(spark, sf_dir):
    return quality.run_suite(catalogue(spark, sf_dir), "nomenclador", quality.CATALOGUE_SUITE)


def dq_providers(spark, sf_dir):
    return quality.run_suite(providers(spark, sf_dir), "prestadores", quality.PROVIDER_SUITE)


def dq_costs(spark, sf_dir):
    return quality.run_suite(A.costs(spark, sf_dir), "costos", quality.COST_SUITE)


def dq_summary(spark, sf_dir):
    raw = quality.run_suite(A.raw_catalogue(spark, sf_dir), "catalogue_raw", quality.CATALOGUE_SUITE)
    raw_providers = quality.run_suite(
        A.raw_providers(spark, sf_dir), "providers_raw", quality.PROVIDER_SUITE
    )
    reports = raw.unionByName(raw_providers).unionByName(dq_catalog(spark, sf_dir)).unionByName(
        dq_providers(spark, sf_dir)
    )
    return quality.summarise(reports)


def dq_audit(spark, sf_dir):
    """The checks of a run as kept in the audit table; a repeated run id leaves one copy."""
    path = f"{scratch_folder(spark)}/audit-{uuid.uuid4().hex}"
    report = dq_catalog(spark, sf_dir).unionByName(dq_providers(spark, sf_dir))
    for _ in range(2):
        append_audit(report, path, RUN.run_id)
    return spark.read.schema(AUDIT).parquet(path)


def dq_report_file(spark, sf_dir):
    """The summaries as exported to JSON and read back for the gate."""
    path = f"{scratch_folder(spark)}/report-{uuid.uuid4().hex}"
    report = quality.run_suite(A.raw_catalogue(spark, sf_dir), "catalogue_raw", quality.CATALOGUE_SUITE)
    both = report.unionByName(dq_costs(spark, sf_dir))
    write_report_json(quality.summaries_with_checks(both, RUN.started.isoformat()), path)
    return spark.read.json(path).select("df", "total_checks", "failed", "warned", "overall", "run_ts")


# Star schema -------------------------------------------------------------------------------


def dim_tiempo(spark, sf_dir):
    return months(spark, sf_dir)


def fact_enriched(spark, sf_dir):
    return star.enrich(full(spark, sf_dir), staged_providers(spark, sf_dir), staged_catalogue(spark, sf_dir))


def surrogate_keys(spark, sf_dir):
    return A.costs(spark, sf_dir).select(
        *GRAIN,
        star.fact_key().alias("fact_id"),
        surrogate_key(F.col("codigo_sns")).alias("medicamento_sk"),
    )


def fact_grain(spark, sf_dir):
    """Repeated keys at a coarser grain than the fact's, where they do occur."""
    return quality.grain_violations(A.costs(spark, sf_dir), ["prestador_id", "periodo"])


def fact_star(spark, sf_dir):
    history = staged_history(spark, sf_dir)
    rows = star.star_fact(full(spark, sf_dir, history), history, staged_catalogue(spark, sf_dir), RUN)
    return comparable(rows.drop("_calc_ts"))


def sink_roundtrip(spark, sf_dir):
    """The fact written twice, month by month, with its layout, and read back."""
    base = f"{scratch_folder(spark)}/warehouse-{uuid.uuid4().hex}"
    spec = WAREHOUSE["fact_costos_prestacionales"]
    history = staged_history(spark, sf_dir)
    # Neighbours of one provider compress better, in the table and in the shuffle by provider.
    costs = stage(A.costs(spark, sf_dir).sortWithinPartitions("prestador_id", "periodo"), "costs")
    narrow = variance.narrow_variance(costs, history=history, ranked=False).drop("desvio_pct_anterior")
    keyed = star.with_dimension_keys(narrow, history, staged_catalogue(spark, sf_dir))
    # What both writes share is what takes shuffles, the gathering by month too; the other columns are computed as rows are written.
    staged = stage(variance.ranked_by_month(keyed, costs).sortWithinPartitions("periodo", "prestador_id"), "fact")
    rows = variance.with_bands(variance.with_ratio(staged)).drop("desvio_pct", "desvio_abs_ars")

    def finish(df):
        return star.as_fact(variance.with_ratio(df), RUN)

    path = write_spec(rows, spec, base, finish=finish, gathered=True).target
    # A rerun of some months replaces them and leaves the others alone.
    rerun = rows.filter(F.col("periodo") >= "2000")
    write_table(rerun, path, partition_by=spec.partition_by, cluster_by=spec.cluster_by, finish=finish, gathered=True)
    return comparable(spark.read.schema(FACT).parquet(path).drop("_calc_ts"))


def monthly_run(spark, sf_dir):
    """The whole monthly run over landing tables made from the given ones; returns the fact."""
    base = f"{scratch_folder(spark)}/run-{uuid.uuid4().hex}"
    A.raw_catalogue(spark, sf_dir).drop("p_partkey").write.parquet(f"{base}/raw/nomenclador")
    A.raw_providers(spark, sf_dir).drop("ver").write.parquet(f"{base}/raw/prestadores")
    A.costs(spark, sf_dir).write.option("compression", "zstd").parquet(f"{base}/raw/costos")
    result = run_monthly(spark, use_mock=False, landing=f"{base}/raw", output=f"{base}/dw", run=RUN)
    return comparable(spark.read.schema(FACT).parquet(result["fact"]).drop("_calc_ts"))


def dim_catalog(spark, sf_dir):
    return comparable(star.catalogue_dimension(catalogue(spark, sf_dir)).drop("_ingestion_ts"))


# Provider history --------------------------------------------------------------------------


def scd2_history(spark, sf_dir):
    return comparable(provider_history(spark, sf_dir))


def scd2_incremental(spark, sf_dir):
    """The same history, one snapshot after the other."""
    snapshots = A.provider_snapshots(spark, sf_dir)
    first, *later = sorted(snapshots)
    dimension = scd2.history({first: snapshots[first]})
    for day in later:
        dimension = scd2.merge_snapshot(dimension, snapshots[day], day)
    return comparable(dimension)


def scd2_current(spark, sf_dir):
    return comparable(scd2.current(provider_history(spark, sf_dir)))


def pit_join(spark, sf_dir):
    rows = A.costs(spark, sf_dir).select(*GRAIN)
    columns = ("prestador_sk", "region", "habilitado", "fecha_inicio")
    return comparable(scd2.as_of_month(rows, staged_history(spark, sf_dir), columns=columns))


# Reports -----------------------------------------------------------------------------------


def period_summary(spark, sf_dir):
    return marts.period_summary(trended(spark, sf_dir), months(spark, sf_dir))


def top_providers(spark, sf_dir):
    return marts.top_providers(trended(spark, sf_dir), provider_history(spark, sf_dir))


def smoke_orphans(spark, sf_dir):
    return audit.orphan_facts(A.costs(spark, sf_dir), providers(spark, sf_dir))


def smoke_alerts(spark, sf_dir):
    return audit.alerts_without_variance(banded(spark, sf_dir))


def severity_profile(spark, sf_dir):
    profile = audit.severity_profile(banded(spark, sf_dir))
    return profile.withColumn("desvio_avg", F.round("desvio_avg", 6))


QUERIES = {
    query.__name__: query
    for query in (
        variance_pct, variance_alert, severity_bands, variance_lag, trend, variance_rank,
        provider_month_total, variance_full, active_alerts,
        scan_contract, contract_nulls, csv_seed, latest_per_key, dedup_providers, clean_catalog,
        clean_providers,
        dq_null_rate, dq_uniqueness, dq_range, dq_catalog, dq_providers, dq_costs, dq_summary, dq_audit,
        dq_report_file,
        dim_tiempo, fact_enriched, surrogate_keys, fact_grain, fact_star, sink_roundtrip, monthly_run,
        dim_catalog,
        scd2_history, scd2_incremental, scd2_current, pit_join,
        period_summary, top_providers, smoke_orphans, smoke_alerts, severity_profile,
    )
}
QUERIES |= LOAD_QUERIES
