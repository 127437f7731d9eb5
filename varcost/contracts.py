"""Data contracts: the declared shape of every input and warehouse table.

A contract is a ``StructType``. Parquet reads make every column nullable and turn a missing
column into NULLs, so a contract is enforced here in two steps: column names and types are
compared on the analysed schema (no job), and NOT NULL columns are counted in one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ContractError(ValueError):
    """A frame's columns do not match its contract."""


def contract(*columns: tuple[str, str, bool]) -> StructType:
    """Build a schema from ``(name, type, nullable)`` triples."""
    schema = StructType()
    for name, type_name, nullable in columns:
        schema = schema.add(name, type_name, nullable)
    return schema


REQUIRED, OPTIONAL = False, True

# Raw input contracts.
CATALOGUE = contract(
    ("codigo_sns", "string", REQUIRED),
    ("nombre", "string", REQUIRED),
    ("laboratorio", "string", OPTIONAL),
    ("precio_ref", "double", REQUIRED),
    ("unidad_medida", "string", OPTIONAL),
    ("vigente", "boolean", REQUIRED),
    ("fecha_vigencia", "timestamp", OPTIONAL),
)
PROVIDERS = contract(
    ("prestador_id", "string", REQUIRED),
    ("nombre", "string", REQUIRED),
    ("especialidad", "string", OPTIONAL),
    ("region", "string", OPTIONAL),
    ("habilitado", "boolean", REQUIRED),
    ("cuit", "string", OPTIONAL),
)
COSTS = contract(
    ("prestador_id", "string", REQUIRED),
    ("periodo", "string", REQUIRED),
    ("codigo_sns", "string", REQUIRED),
    ("costo_real", "double", REQUIRED),
    ("costo_ppto", "double", REQUIRED),
    ("cantidad", "integer", OPTIONAL),
)

# Warehouse contracts.
DIM_PROVIDER = contract(
    ("prestador_sk", "string", REQUIRED),
    ("prestador_id", "string", REQUIRED),
    ("nombre", "string", OPTIONAL),
    ("especialidad", "string", OPTIONAL),
    ("region", "string", OPTIONAL),
    ("cuit", "string", OPTIONAL),
    ("cuit_valido", "boolean", OPTIONAL),
    ("habilitado", "boolean", REQUIRED),
    ("fecha_inicio", "date", REQUIRED),
    ("fecha_fin", "date", OPTIONAL),
    ("es_vigente", "boolean", REQUIRED),
    ("_source", "string", OPTIONAL),
    ("_ingestion_ts", "timestamp", OPTIONAL),
)
DIM_CATALOGUE = contract(
    ("medicamento_sk", "string", REQUIRED),
    ("codigo_sns", "string", REQUIRED),
    ("nombre", "string", OPTIONAL),
    ("laboratorio", "string", OPTIONAL),
    ("unidad_medida", "string", OPTIONAL),
    ("precio_ref", "decimal(38,9)", OPTIONAL),
    ("vigente", "boolean", OPTIONAL),
    ("fecha_vigencia", "date", OPTIONAL),
    ("_source", "string", OPTIONAL),
    ("_ingestion_ts", "timestamp", OPTIONAL),
)
DIM_MONTH = contract(
    ("periodo_id", "string", REQUIRED),
    ("anio", "long", REQUIRED),
    ("mes", "long", REQUIRED),
    ("trimestre", "long", REQUIRED),
    ("semestre", "long", REQUIRED),
    ("nombre_mes", "string", OPTIONAL),
    ("es_fin_de_anio", "boolean", OPTIONAL),
    ("es_periodo_alta", "boolean", OPTIONAL),
    ("es_periodo_cierre", "boolean", OPTIONAL),
)
FACT = contract(
    ("fact_id", "string", REQUIRED),
    ("prestador_sk", "string", REQUIRED),
    ("medicamento_sk", "string", REQUIRED),
    ("periodo_id", "string", REQUIRED),
    ("prestador_id", "string", REQUIRED),
    ("codigo_sns", "string", REQUIRED),
    ("periodo", "string", REQUIRED),
    ("costo_real", "decimal(38,9)", REQUIRED),
    ("costo_ppto", "decimal(38,9)", REQUIRED),
    ("cantidad", "long", OPTIONAL),
    ("desvio_pct", "double", OPTIONAL),
    ("desvio_abs_ars", "decimal(38,9)", OPTIONAL),
    ("costo_real_acum_prestador", "decimal(38,9)", OPTIONAL),
    ("alerta_flag", "boolean", OPTIONAL),
    ("severidad", "string", OPTIONAL),
    ("tendencia", "string", OPTIONAL),
    ("rank_desvio_periodo", "long", OPTIONAL),
    ("run_id", "string", OPTIONAL),
    ("_calc_ts", "timestamp", OPTIONAL),
    ("_pipeline_version", "string", OPTIONAL),
)


@dataclass(frozen=True)
class TableSpec:
    """A warehouse table: contract, file layout and catalogue metadata."""

    name: str
    schema: StructType
    partition_by: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()
    defaults: tuple[tuple[str, str], ...] = ()
    column_comments: tuple[tuple[str, str], ...] = ()
    comment: str = ""
    labels: tuple[tuple[str, str], ...] = ()


# Providers and catalogue are small per day of validity, so a partition per date would make
# many tiny files: they are sorted on their cluster columns instead. Only the fact, which grows
# every month, is partitioned.
WAREHOUSE = {
    spec.name: spec
    for spec in (
        TableSpec(
            "dim_prestador",
            DIM_PROVIDER,
            cluster_by=("region", "especialidad"),
            defaults=(("es_vigente", "true"),),
            comment="Providers, type-2 history",
            labels=(("env", "prod"), ("team", "data-engineering")),
        ),
        TableSpec(
            "dim_medicamento",
            DIM_CATALOGUE,
            cluster_by=("laboratorio", "codigo_sns"),
            comment="Drug catalogue with reference prices",
            labels=(("env", "prod"), ("team", "data-engineering")),
        ),
        TableSpec(
            "dim_tiempo",
            DIM_MONTH,
            column_comments=(
                ("es_periodo_alta", "Seasonal demand peak"),
                ("es_periodo_cierre", "Quarterly budget close"),
            ),
            comment="Monthly calendar with seasonality flags",
        ),
        TableSpec(
            "fact_costos_prestacionales",
            FACT,
            partition_by=("periodo",),
            cluster_by=("prestador_id", "severidad", "alerta_flag"),
            comment="Cost variance per provider, drug and month",
            labels=(("env", "prod"), ("team", "data-engineering"), ("sensitivity", "high")),
        ),
    )
}


def enforce_contract(df: DataFrame, schema: StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """Return the contract's columns, in order, or raise before any job runs.

    ``extra`` names further columns to keep, for instance a load sequence used as tie-breaker.
    """
    actual = {field.name: field.dataType for field in df.schema}
    missing = [name for name in (*schema.names, *extra) if name not in actual]
    mistyped = [
        f"{f.name}: {actual[f.name].simpleString()} instead of {f.dataType.simpleString()}"
        for f in schema
        if f.name in actual and actual[f.name] != f.dataType
    ]
    if missing or mistyped:
        raise ContractError(f"missing columns {missing}, wrong types {mistyped}")
    return df.select(*schema.names, *extra)


def null_violations(df: DataFrame, schema: StructType) -> DataFrame:
    """Rows ``(columna, nulos)``: NULLs found in each NOT NULL column, in one aggregate."""
    required = [f.name for f in schema if not f.nullable]
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required))
    return counts.select(
        F.inline(F.array(*(
            F.struct(F.lit(c).alias("columna"), F.col(c).alias("nulos")) for c in required
        )))
    )


def conform_to(df: DataFrame, schema: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Select and cast to a warehouse contract, filling missing keys and absent columns.

    ``defaults`` replaces NULLs of the named columns. A nullable column the frame lacks becomes
    NULL; a required one without a default is an error.
    """
    defaults = defaults or {}
    have = set(df.columns)
    absent = [f.name for f in schema if f.name not in have and not f.nullable and f.name not in defaults]
    if absent:
        raise ContractError(f"required columns {absent} are missing")

    def projected(field):
        value = F.col(field.name) if field.name in have else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        return value.cast(field.dataType).alias(field.name)

    return df.select(*(projected(f) for f in schema))


__all__ = [
    "CATALOGUE", "PROVIDERS", "COSTS", "DIM_PROVIDER", "DIM_CATALOGUE", "DIM_MONTH", "FACT",
    "WAREHOUSE", "TableSpec", "ContractError", "contract", "conform_to", "enforce_contract",
    "null_violations",
]
