"""Queries of the loading features, over the given tables: contracts per file, monthly loads, quarantine, warehouse, roll-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varcost.contracts import COSTS, contract
from varcost.operators import asof, quarantine, reconcile, rollup, scd2, variance
from varcost.plans.monthly import run_monthly
from varcost.plans.trends import load_trends
from varcost.sinks import buckets, clustering, ledger
from varcost.sinks.scratch import scratch_folder, stage
from varcost.sinks.writers import laid_out, write_table
from varcost.sources.calendar import calendar_of
from varcost.sources.footers import contract_problems
from varcost.sources.readers import read_csv
from workload import adapters as A

GRAIN = ("prestador_id", "periodo", "codigo_sns")
BUDGET = contract(
    ("prestador_id", "string", True), ("periodo", "string", True), ("codigo_sns", "string", True), ("costo_ppto", "double", True)
)
# The last months are loaded one by one; one older month is wrong at first and loaded again at the end.
FIRST_MONTHLY, RELOADED = "200101", "199906"


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _staged_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(A.costs(spark, sf_dir), "costs")


def _mark():
    """A number from 0 to 96 for each provider and month, by which defects are planted."""
    return (F.substring("prestador_id", 2, 18).cast("long") * 31 + F.col("periodo").cast("long")) % 97


def contract_files(spark, sf_dir):
    """Which files of a landing folder depart from the contract, and how many rows they hold."""
    base, rows = _new_folder(spark, "landing"), _staged_costs(spark, sf_dir)
    kinds = {
        "good": rows,
        "missing": rows.drop("costo_ppto"),
        "mistyped": rows.withColumn("cantidad", F.col("cantidad").cast("long")),
        "extra": rows.withColumn("nota", F.lit("x")),
    }
    files = []
    for name, frame in kinds.items():
        frame.write.parquet(f"{base}/{name}")
        files += spark.read.parquet(f"{base}/{name}").inputFiles()
    folder = F.regexp_extract("file", "/([a-z]+)/[^/]*$", 1).alias("carpeta")
    return contract_problems(spark, files, COSTS).groupBy(folder, "columna", "problema", "tipo").agg(F.sum("filas").alias("filas"))


def trend_incremental(spark, sf_dir):
    """The trend of every row after years of monthly loads, the last of which repairs an old month."""
    path, costs = _new_folder(spark, "trends"), variance.with_ratio(A.costs(spark, sf_dir))
    # Months are folders, as they come in, so that a load reads its own and not the whole table.
    landed = write_table(costs, _new_folder(spark, "scored"), partition_by=["periodo"])
    rows = landed.read(spark, costs.schema).select(*costs.columns)
    early = F.col("periodo") < FIRST_MONTHLY
    wrong = F.when(F.col("periodo") == RELOADED, 1 - F.col("desvio_pct")).otherwise(F.col("desvio_pct"))
    load_trends(rows.filter(early).withColumn("desvio_pct", wrong), path, "history")
    months = sorted(r[0] for r in rows.filter(~early).select("periodo").distinct().collect())
    for month in [*months, RELOADED]:
        table = load_trends(rows.filter(F.col("periodo") == month), path, f"{month}-load")
    return table.select(*GRAIN, "desvio_pct", "tendencia")


def cost_quarantine(spark, sf_dir):
    """Costs with planted defects, each row with where it goes and why."""
    mark = _mark()
    rows = _staged_costs(spark, sf_dir).withColumn("mark", mark)
    copies = F.when(F.col("mark") == 13, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    planted = rows.withColumn("copy", F.explode(copies)).withColumns({
        "prestador_id": F.when(~F.col("mark").isin(5, 17), F.col("prestador_id")),
        "periodo": F.when(F.col("mark").isin(7, 17), "999999").otherwise(F.col("periodo")),
        "costo_ppto": F.when(F.col("mark") != 11, F.col("costo_ppto")),
    }).drop("mark", "copy")
    rules = [*quarantine.required(COSTS), quarantine.month_rule()]
    kept, held = quarantine.routed(stage(quarantine.tagged(planted, rules, GRAIN), "tagged"))
    out = kept.withColumn("destino", F.lit("fact")).withColumn("motivos", F.lit("")).unionByName(
        held.withColumn("destino", F.lit("quarantine")).withColumn("motivos", F.array_join("motivos", ","))
    )
    return out.select(*GRAIN, "costo_real", "costo_ppto", "destino", "motivos")


def warehouse_views(spark, sf_dir):
    """Both lasting views, read by SQL after a run into catalogue tables."""
    base, database = _new_folder(spark, "run"), f"dw_{uuid.uuid4().hex}"
    A.raw_catalogue(spark, sf_dir).drop("p_partkey").write.parquet(f"{base}/raw/nomenclador")
    A.raw_providers(spark, sf_dir).drop("ver").write.parquet(f"{base}/raw/prestadores")
    A.costs(spark, sf_dir).write.option("compression", "zstd").parquet(f"{base}/raw/costos")
    run_monthly(spark, use_mock=False, landing=f"{base}/raw", output=f"{base}/dw", database=database)
    return spark.sql(f"""
        SELECT 'resumen' AS vista, periodo_id, CAST(NULL AS string) AS prestador_id, total_transacciones AS n,
               costo_real_total AS costo_real, desvio_pct_consolidado AS desvio
        FROM {database}.v_resumen_desvios_periodo
        UNION ALL
        SELECT 'top', periodo_id, prestador_id, rank_periodo, costo_real, desvio_pct_prestador
        FROM {database}.v_top_prestadores_desvio
    """)


def scd2_bucketed(spark, sf_dir):
    """The provider history after three merges into hashed buckets."""
    path, snapshots = _new_folder(spark, "bucketed"), A.provider_snapshots(spark, sf_dir)
    for day in sorted(snapshots):
        buckets.merge_bucketed(snapshots[day], path, day)
    whole = scd2.history({min(snapshots): snapshots[min(snapshots)]})
    dimension = buckets.read_bucketed(spark, path, whole.schema).drop("bucket")
    return dimension.withColumns({c: F.col(c).cast("string") for c in ("fecha_inicio", "fecha_fin")})


def ledger_rerun(spark, sf_dir):
    """Variances appended by a run that broke once midway and was then run twice."""
    path = _new_folder(spark, "ledger")
    rows = stage(variance.with_bands(variance.with_ratio(A.costs(spark, sf_dir))).select(*GRAIN, "desvio_pct", "severidad"), "banded")
    # What a run leaves that broke before its commit: some months' files, and no row of the ledger.
    half = rows.filter(F.col("periodo") < "1995")
    laid_out(half, ["periodo"]).write.partitionBy("periodo").parquet(f"{path}/data/load=broken")
    for _ in range(2):
        ledger.append_once(rows, path, "run", cluster_by=["prestador_id"])
    # A run of its own that replaces a month.
    ledger.append_once(rows.filter(F.col("periodo") == "199505"), path, "repair")
    return ledger.read_committed(spark, path, rows.schema)


def clustered_scan(spark, sf_dir):
    """Costs laid out along a curve through three columns, filtered by each of them."""
    path, rows = _new_folder(spark, "clustered"), _staged_costs(spark, sf_dir)
    clustering.clustered(rows, ["prestador_id", "codigo_sns", "periodo"]).write.parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    filters = {
        "provider": F.col("prestador_id").between("P0003", "P0009"), "drug": F.col("codigo_sns") == "BRAND#23",
        "month": F.col("periodo").startswith("1996"),
    }
    parts = [table.filter(condition).select(F.lit(name).alias("filtro"), *GRAIN, "costo_real") for name, condition in filters.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def period_rollup(spark, sf_dir):
    """Distinct providers per month, quarter and year, from the months' bitmaps."""
    rows = _staged_costs(spark, sf_dir).select(F.col("periodo").alias("periodo_id"), "prestador_id")
    ids = stage(rollup.dense_ids(rows, "prestador_id"), "ids")
    states = stage(rollup.distinct_states(rows, ["periodo_id"], "prestador_id", ids), "states")
    months = calendar_of(A.table(spark, sf_dir, "lineitem"), F.col("l_shipdate"))
    return rollup.period_rollup(states, months)


def pit_merge(spark, sf_dir):
    """The versions in force, by merging facts and versions in time order."""
    rows = A.costs(spark, sf_dir).select(*GRAIN)
    history = stage(scd2.history(A.provider_snapshots(spark, sf_dir)), "history")
    columns = ("prestador_sk", "region", "habilitado", "fecha_inicio")
    return asof.as_of_month_merge(rows, history, columns=columns, salt=4).withColumn("fecha_inicio", F.col("fecha_inicio").cast("string"))


def budget_reconcile(spark, sf_dir):
    """A CSV budget seed with planted differences against the actuals."""
    path, rows = _new_folder(spark, "seed"), _staged_costs(spark, sf_dir)
    mark = _mark()
    copies = F.when(mark == 13, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    seed = rows.filter(mark != 5).select(
        "prestador_id", "periodo", F.when(mark == 7, "BRAND#99").otherwise(F.col("codigo_sns")).alias("codigo_sns"),
        F.when(mark == 11, F.col("costo_ppto") + 100).otherwise(F.col("costo_ppto")).alias("costo_ppto"), copies.alias("copies"),
    ).withColumn("copy", F.explode("copies")).drop("copy", "copies")
    seed.write.option("header", True).csv(path)
    found = reconcile.budget_reconcile(read_csv(spark, path, BUDGET), rows, tolerance=0.005)
    return found.withColumns({c: F.round(c, 4) for c in ("monto_presupuesto", "monto_real", "diferencia")})


QUERIES = {
    query.__name__: query
    for query in (
        contract_files, trend_incremental, cost_quarantine, warehouse_views, scd2_bucketed, ledger_rerun, clustered_scan,
        period_rollup, pit_merge, budget_reconcile,
    )
}
