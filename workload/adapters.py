"""The given tables in the shape of the library's inputs. Formulas are in FIXTURES.md."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varcost.contracts import CATALOGUE, COSTS, PROVIDERS, contract, enforce_contract
from varcost.operators.cleaning import normalise_providers
from varcost.sinks.scratch import stage
from varcost.sources.readers import read_parquet

LINEITEM = contract(
    ("l_partkey", "long", True),
    ("l_suppkey", "long", True),
    ("l_linenumber", "integer", True),
    ("l_quantity", "double", True),
    ("l_extendedprice", "double", True),
    ("l_discount", "double", True),
    ("l_returnflag", "string", True),
    ("l_shipdate", "timestamp_ntz", True),
)
PART = contract(
    ("p_partkey", "long", True),
    ("p_name", "string", True),
    ("p_brand", "string", True),
    ("p_type", "string", True),
    ("p_size", "integer", True),
    ("p_retailprice", "double", True),
)
SUPPLIER = contract(
    ("s_suppkey", "long", True),
    ("s_name", "string", True),
    ("s_nationkey", "integer", True),
    ("s_acctbal", "double", True),
)
NATION = contract(("n_nationkey", "integer", True), ("n_regionkey", "integer", True))
REGION = contract(("r_regionkey", "integer", True), ("r_name", "string", True))

SNAPSHOT_DATES = (date(1995, 1, 1), date(1997, 3, 15), date(1999, 9, 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = {"lineitem": LINEITEM, "part": PART, "supplier": SUPPLIER, "nation": NATION, "region": REGION}
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", schema[name])


def provider_id(key: Column) -> Column:
    return F.format_string("P%04d", key)


def _hundredths(amount: Column) -> Column:
    """A non-negative amount with two decimals as a whole number of hundredths."""
    return F.floor(amount * 100 + 0.5)


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual and budget per supplier, month and brand."""
    month = F.year("l_shipdate") * 100 + F.month("l_shipdate")
    # Amounts have two decimals, shares are whole percents: their products are exact integers in
    # units of 1/10000, which add up much faster than decimals and in any order.
    cents = _hundredths(F.col("l_extendedprice"))
    no_budget = (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")
    # Products are made after the join: their factors are shorter, so less travels.
    actual = F.col("cents") * F.col("percent")
    budget = F.when(F.col("no_budget"), F.lit(0)).otherwise(F.col("cents") * (75 + F.col("l_quantity").cast("long")))
    brands = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.upper("p_brand").alias("codigo_sns")
    )
    # Integer keys go through the shuffle; text is built once per group.
    grouped = (
        table(spark, sf_dir, "lineitem")
        .select("l_partkey", "l_suppkey", month.alias("month"), "l_quantity", cents.alias("cents"),
                (100 - _hundredths(F.col("l_discount"))).alias("percent"), no_budget.alias("no_budget"))
        .join(brands, "l_partkey")
        .groupBy("l_suppkey", "month", "codigo_sns")
        .agg(
            (F.sum(actual) / 10000).alias("costo_real"),
            (F.sum(budget) / 10000).alias("costo_ppto"),
            F.sum("l_quantity").cast("int").alias("cantidad"),
        )
    )
    named = grouped.select(
        provider_id(F.col("l_suppkey")).alias("prestador_id"),
        F.col("month").cast("string").alias("periodo"),
        "codigo_sns", "costo_real", "costo_ppto", "cantidad",
    )
    return enforce_contract(named, COSTS)


def raw_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows with the planted defects; ``p_partkey`` stays as load sequence."""
    key = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select(
        F.when(key % 3 == 0, F.concat(F.lit(" "), F.lower("p_brand"))).otherwise(F.col("p_brand"))
        .alias("codigo_sns"),
        F.upper("p_name").alias("nombre"),
        F.when(key % 4 != 0, F.col("p_type")).alias("laboratorio"),
        F.when(key % 50 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice")).alias("precio_ref"),
        F.when(key % 6 != 0, F.lit("CAPS")).alias("unidad_medida"),
        (key % 5 != 0).alias("vigente"),
        F.date_add(F.lit(date(2020, 1, 1)), F.col("p_size")).cast("timestamp").alias("fecha_vigencia"),
        key,
    )
    return enforce_contract(raw, CATALOGUE, extra=("p_partkey",))


def _region(name: Column) -> Column:
    spelled = {"AFRICA": " gba norte", "AMERICA": "CABA", "ASIA": "Interior ", "EUROPE": "patagonia"}
    value = F
    for source, target in spelled.items():
        value = value.when(name == source, F.lit(target))
    return value.otherwise("ATLANTIS")


def _cuit(key: Column) -> Column:
    full = F.format_string("30-%08d-%d", key, key % 10)
    return F.when(key % 11 == 0, F.lit(None)).when(key % 7 == 0, F.format_string("30-%d", key)).otherwise(full)


def raw_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider rows with a second copy of some ids; ``ver`` tells copies apart."""
    regions = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").join(regions, F.col("s_nationkey") == F.col("n_nationkey"))
    versions = F.when(key % 10 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1)))
    enabled = F.col("s_acctbal") >= 0
    raw = rows.withColumn("ver", F.explode(versions)).select(
        provider_id(key).alias("prestador_id"),
        F.when(F.col("ver") == 1, F.col("s_name")).otherwise(F.concat("s_name", F.lit(" BIS"))).alias("nombre"),
        F.concat(F.lit("ESP-"), (key % 6).cast("string")).alias("especialidad"),
        _region(F.col("r_name")).alias("region"),
        F.when(F.col("ver") == 1, enabled).otherwise(~enabled).alias("habilitado"),
        _cuit(key).alias("cuit"),
        "ver",
    )
    return enforce_contract(raw, PROVIDERS, extra=("ver",))


def provider_snapshots(spark: SparkSession, sf_dir: str) -> dict[date, DataFrame]:
    """Three full snapshots of the normalised providers with planted changes."""
    normal = stage(normalise_providers(raw_providers(spark, sf_dir), ["ver"]), "providers")
    key = F.substring("prestador_id", 2, 18).cast("long")
    region = (
        F.col("region"),
        F.when(key % 5 == 1, "NOA").otherwise(F.col("region")),
        F.when(key % 10 == 1, "CUYO").otherwise(F.col("region")),
    )
    snapshots = {}
    for i, day in enumerate(SNAPSHOT_DATES):
        enabled = F.lit(True) if i == 0 else key % 9 != 2
        rows = normal.withColumns({"region": region[i], "habilitado": enabled})
        snapshots[day] = rows.filter(key % 13 != 3) if i == 0 else rows
    return snapshots
