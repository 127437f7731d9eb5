"""The monthly run: raw tables in, gated and audited star schema out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from varcost import constants as K
from varcost.contracts import CATALOGUE, COSTS, DIM_PROVIDER, FACT, PROVIDERS, WAREHOUSE, conform_to
from varcost.operators import cleaning, quality, quarantine, scd2, star
from varcost.operators.variance import ranked_by_month, with_bands, with_ratio, with_totals
from varcost.plans.trends import corrected_months, first_load, trend_load
from varcost.session import get_spark
from varcost.sinks.scratch import scratch_folder, stage
from varcost.sinks.versions import read_latest, version_path, write_version
from varcost.sinks.warehouse import publish
from varcost.sinks.writers import FILE_FORMATS, append_audit, write_report_json, write_table
from varcost.sources.calendar import calendar
from varcost.sources.demo import demo_frames
from varcost.sources.readers import read_parquet

# The calendar's span.
CALENDAR_FIRST, CALENDAR_LAST = date(2020, 1, 1), date(2026, 12, 1)

# The first load of a provider says nothing about when it began, so its version covers the past.
BEGINNING = date(1900, 1, 1)

GRAIN = quality.COST_GRAIN

AUDIT_COLUMNS = ("_source", "_ingestion_ts")


def landing_frames(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalogue, providers and costs from the landing folder."""
    return (
        read_parquet(spark, f"{base}/nomenclador", CATALOGUE),
        read_parquet(spark, f"{base}/prestadores", PROVIDERS),
        read_parquet(spark, f"{base}/costos", COSTS),
    )


def calendar_span(costs: DataFrame) -> tuple[date, date]:
    """The fixed span, extended to all months of the costs."""
    month = F.try_to_date(F.col("periodo"), "yyyyMM")
    low, high = costs.agg(F.min(month), F.max(month)).first()
    return min(low or CALENDAR_FIRST, CALENDAR_FIRST), max(high or CALENDAR_LAST, CALENDAR_LAST)


def quality_report(catalogue: DataFrame, providers: DataFrame, costs: DataFrame) -> DataFrame:
    """All suites of a run, one aggregate per data set. Costs are tagged: their repeated keys are known."""
    repeated = F.array_contains(quarantine.REASONS, quarantine.REPEATED)
    cost_suite = [replace(c, repeated=repeated) if c == quality.Uniqueness(GRAIN) else c for c in quality.COST_SUITE]
    suites = (
        (catalogue, "nomenclador", quality.CATALOGUE_SUITE),
        (providers, "prestadores", quality.PROVIDER_SUITE),
        (costs, "costos", cost_suite),
    )
    return reduce(DataFrame.unionByName, (quality.run_suite(*suite) for suite in suites))


def merged_providers(
    known: DataFrame | None, providers: DataFrame, on: date
) -> DataFrame:
    """The provider history after this run's snapshot, in warehouse shape."""
    if known is None:
        versions = scd2.history({BEGINNING: providers}, carried=AUDIT_COLUMNS)
    else:
        versions = scd2.merge_snapshot(known, providers, on, carried=AUDIT_COLUMNS, new_since=BEGINNING)
    return conform_to(versions, DIM_PROVIDER)


def cost_rules(limits: Mapping[str, float] | None = None) -> list[quarantine.Rule]:
    """What every cost row must keep: the contract's NOT NULL columns and a month that exists.

    ``limits`` are the shares of rows that may break a rule, by its name (``null:prestador_id``, ``month:periodo``); 0 by default.
    """
    limits = limits or {}
    return [*quarantine.required(COSTS, limits), quarantine.month_rule("periodo", limits.get("month:periodo", 0.0))]


def loaded_fact(spark: SparkSession, path: str) -> DataFrame | None:
    """The fact as loaded before, or None."""
    try:
        return spark.read.schema(FACT).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def run_monthly(
    spark: SparkSession | None = None,
    use_mock: bool = True,
    landing: str | None = None,
    output: str | None = None,
    fmt: str = "parquet",
    dataset: str | None = None,
    snapshot_date: date | None = None,
    dq_report_path: str | None = None,
    fail_on_dq_error: bool = True,
    run: star.Run | None = None,
    options: dict[str, str] | None = None,
    limits: Mapping[str, float] | None = None,
    database: str | None = None,
) -> dict:
    """Clean, check, compute and write; returns the run's summary.

    Nothing is written under ``output`` before the quality gate has passed. A second run over the
    same data leaves the same tables. The costs may be one month or many: trends go on from the carry of earlier loads, and
    where a month is loaded again, later months are corrected.

    Cost rows that break a rule of :func:`cost_rules` or repeat the fact's grain stop the run, unless ``limits`` allows for their share
    (``grain`` for repeats) or the gate is off; then they go to the quarantine table with their reasons, not to the fact.

    ``fmt`` other than Parquet writes the dimensions and the fact to ``dataset``'s tables in that format, or under ``output`` if the
    format is not installed. ``database`` names a catalogue database whose tables are pointed to what the run has written, with
    both report views; it goes with file formats.
    """
    spark = spark or get_spark()
    run = run or star.Run.now()
    if not use_mock and (landing is None or output is None):
        raise ValueError("a production run needs the landing folder and the output folder")
    output = output or f"{scratch_folder(spark)}/warehouse"
    if database and fmt != "parquet":
        raise ValueError("catalogue tables are Parquet")
    raw_catalogue, raw_providers, raw_costs = demo_frames(spark) if use_mock else landing_frames(spark, landing)

    # Cleaned once; the checks, the dimensions and the fact all read the staged result.
    catalogue = stage(cleaning.clean_catalogue(raw_catalogue, run_ts=run.timestamp), "catalogue")
    all_providers = stage(
        cleaning.normalise_providers(raw_providers).withColumns({
            "_source": F.lit(K.SOURCE_PROVIDERS), "_ingestion_ts": run.timestamp,
        }),
        "providers",
    )
    enabled = all_providers.filter("habilitado")

    # One pass over the costs tags their rows; the checks, the fact and the quarantine read the staged result.
    rules, grain_limit = cost_rules(limits), (limits or {}).get(quarantine.REPEATED, 0.0)
    tagged = stage(quarantine.tagged(raw_costs, rules, GRAIN), "costs")
    costs, held = quarantine.routed(tagged)
    report = stage(quality_report(catalogue, enabled, tagged), "quality")
    broken = stage(quarantine.rule_report(tagged, "costos", rules, grain_limit), "rules")
    summary = quality.summaries_with_checks(report.unionByName(broken), run.started.isoformat())
    if dq_report_path:
        write_report_json(summary, dq_report_path)
    reports = quality.gate(summary) if fail_on_dq_error else quality.collect_summaries(summary)

    append_audit(report, f"{output}/dq_audit", run.run_id)
    append_audit(broken, f"{output}/dq_reglas", run.run_id)
    held_path = f"{output}/cuarentena"
    write_table(held.withColumn("run_id", F.lit(run.run_id)), held_path, partition_by=("run_id",))
    months = calendar(spark, *calendar_span(costs))
    history_path = f"{output}/dim_prestador"
    merged = merged_providers(
        read_latest(spark, history_path), all_providers, snapshot_date or run.started.date()
    )
    # The calendar is the same on every run but for months that come in, so it has no versions.
    locations = {"dim_tiempo": write_table(months, f"{output}/dim_tiempo").target}
    for name, frame in {"dim_prestador": merged, "dim_medicamento": star.catalogue_dimension(catalogue)}.items():
        version = write_version(frame, f"{output}/{name}", run.run_id, WAREHOUSE[name].cluster_by)
        locations[name] = version_path(f"{output}/{name}", version)
    history = read_latest(spark, history_path)
    if fmt not in FILE_FORMATS:
        for name in locations:
            write_table(
                spark.read.schema(WAREHOUSE[name].schema).parquet(locations[name]), f"{dataset}.{name}", fmt,
                cluster_by=WAREHOUSE[name].cluster_by, options=options, fallback=f"{output}/{fmt}/{name}",
            )

    spec = WAREHOUSE["fact_costos_prestacionales"]
    parquet_path = f"{output}/{spec.name}"
    carry_path = f"{output}/carry"
    before = loaded_fact(spark, parquet_path)
    known_carry = read_latest(spark, carry_path)
    if known_carry is None:
        load = first_load(costs, history)
    else:
        load = trend_load(costs, None if before is None else _observations(before), known_carry)
    # Columns that a row gives by itself are computed as it is written.
    trended = load.rows.drop("desvio_pct", "desvio_pct_anterior")
    totalled = trended if known_carry is None else with_totals(trended, costs, history=history)
    keyed = star.with_dimension_keys(totalled, history, catalogue)
    # The last shuffle of the rows: it ranks them and gathers months for the files.
    ranked = ranked_by_month(keyed, costs)
    fact, finish = with_bands(with_ratio(ranked)).drop("desvio_pct", "desvio_abs_ars"), lambda df: star.as_fact(with_ratio(df), run)
    if load.corrected is not None:
        fixed, fact, finish = corrected_months(before, load.corrected), finish(fact), None
        fact = stage(fact if fixed is None else fact.unionByName(fixed), "fact")  # months are replaced that are read
    carry = load.carry if load.corrected is None else stage(load.carry, "carry")  # as in load_trends
    this_run = F.col("run_id") == run.run_id
    seen = Observation("fact")
    metrics = {
        "records_fact": F.count_if(this_run),
        "integridad_prestador": F.count_if(this_run & (F.col("prestador_sk") == K.UNKNOWN_KEY)),
        "unknown_drugs": F.count_if(this_run & (F.col("medicamento_sk") == K.UNKNOWN_KEY)),
        "alertas_sin_desvio": F.count_if(this_run & F.col("desvio_pct").isNull() & F.col("alerta_flag")),
    }
    written = write_table(
        fact,
        parquet_path if fmt in FILE_FORMATS else f"{dataset}.{spec.name}",
        fmt,
        mode="overwrite" if fmt in FILE_FORMATS else "append",
        partition_by=spec.partition_by,
        cluster_by=spec.cluster_by,
        options=options,
        fallback=parquet_path,
        observation=seen,
        metrics=[metric.alias(name) for name, metric in metrics.items()],
        finish=finish,
        gathered=load.corrected is None,
    )
    write_version(carry, carry_path, run.run_id)
    if written.fmt in FILE_FORMATS:
        counts = seen.get  # taken while the fact was written
    else:
        counts = (fact if finish is None else finish(fact)).agg(*(metric.alias(name) for name, metric in metrics.items())).first().asDict()
    if database:
        publish(spark, database, {**locations, spec.name: written.target})
    return {
        "run_id": run.run_id,
        "status": "SUCCESS",
        "dq": {r["df"]: r for r in reports},
        "records_fact": counts.pop("records_fact"),
        "unknown_drugs": counts.pop("unknown_drugs"),
        "fact": written.target,
        "dimensions": locations,
        "quarantine": held_path,
        "smoke": counts,
    }


def _observations(fact: DataFrame) -> DataFrame:
    """What trends need of the fact, in the types of the costs."""
    money = {c: F.col(c).cast("double") for c in ("costo_real", "costo_ppto")}
    return fact.select("prestador_id", "codigo_sns", "periodo", "costo_real", "costo_ppto", "desvio_pct", "tendencia").withColumns(money)
