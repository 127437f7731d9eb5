"""Parquet, CSV and JDBC scans under a data contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from varcost.contracts import ContractError, enforce_contract
from varcost.sources.footers import EXTRA, contract_problems

CORRUPT = "_corrupt_record"
# Departures from a contract that an error names; the rest is in ``contract_problems``.
MAX_TOLD = 20


def read_parquet(spark: SparkSession, path: str, contract: StructType) -> DataFrame:
    """Scan Parquet; a column that is missing or mistyped in any file raises before any row is read.

    Reading with the files' own schema and comparing it is stricter than
    ``read.schema(contract)``, which turns a missing column into NULLs. Spark takes that schema from one file, so of a table of
    several files every footer is compared, by tasks.
    """
    scan = spark.read.parquet(path)
    files = scan.inputFiles()
    if len(files) > 1:
        problems = contract_problems(spark, files, contract, [c for c in scan.columns if f"/{c}=" in files[0]])
        bad = problems.filter(F.col("problema") != EXTRA).orderBy("file", "columna").limit(MAX_TOLD).collect()
        if bad:
            told = "; ".join(f"{r['columna']} is {r['problema']}{' as ' + r['tipo'] if r['tipo'] else ''} in {r['file']}" for r in bad)
            raise ContractError(told)
    return enforce_contract(scan, contract)


def read_csv(
    spark: SparkSession, path: str, contract: StructType, quarantine: bool = False, **options: str
) -> DataFrame:
    """Scan CSV with the contract's types, never inferred ones.

    By default a malformed row fails the job. With ``quarantine`` it is kept with its text in
    ``_corrupt_record``, to be split off by :func:`split_corrupt`.
    """
    reader = spark.read.options(header="true", **options)
    if not quarantine:
        return reader.option("mode", "FAILFAST").schema(contract).csv(path)
    schema = StructType([*contract.fields, StructField(CORRUPT, StringType())])
    return (
        reader.option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(schema)
        .csv(path)
    )


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the texts of malformed ones, of a quarantining CSV scan."""
    return df.filter(df[CORRUPT].isNull()).drop(CORRUPT), df.filter(df[CORRUPT].isNotNull()).select(CORRUPT)


def jdbc_options(
    url: str,
    table: str,
    partition_column: str,
    lower: object,
    upper: object,
    partitions: int,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a partitioned JDBC scan; without bounds one task would read the whole table."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }


def read_jdbc(
    spark: SparkSession, contract: StructType, options: dict[str, str]
) -> DataFrame:
    """Scan a database table; ``options`` come from :func:`jdbc_options` plus credentials."""
    names = {name.lower(): name for name in contract.names}
    scanned = spark.read.format("jdbc").options(**options).load()
    renamed = scanned.withColumnsRenamed(
        {c: names[c.lower()] for c in scanned.columns if c.lower() in names}
    )
    return enforce_contract(renamed, contract)
