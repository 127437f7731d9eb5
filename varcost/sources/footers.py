"""The contract against every file of a Parquet table.

Spark takes the schema of a folder from one of its files and reads columns that other files lack as NULLs. Here the
footer of each file is read, by tasks that take the files' names, and compared with the contract.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType, TimestampType

# What can be wrong with a column of a file; an extra column is told but does no harm.
MISSING, MISTYPED, EXTRA = "missing", "mistyped", "extra"
# Files whose footers one task reads.
FILES_PER_TASK = 64

_FOUND = "file string, filas long, columnas array<struct<columna: string, tipo: string>>"


def _types(path: str) -> tuple[int, list[tuple[str, str]]] | None:
    """Rows and column types in a file's footer; None if its store is unknown to Arrow."""
    try:
        store, name = fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None
    with store.open_input_file(name) as source:
        footer = pq.ParquetFile(source).metadata
    # The oldest timestamps of Parquet, which Spark still writes, have no time zone in Arrow; in Spark they are instants.
    instants = {footer.schema.column(k).path for k in range(len(footer.schema)) if footer.schema.column(k).physical_type == "INT96"}
    return footer.num_rows, [
        (f.name, (TimestampType() if f.name in instants else from_arrow_type(f.type, True)).simpleString())
        for f in footer.schema.to_arrow_schema()
    ]


def _read_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("columna", pa.string()), ("tipo", pa.string())]))
    for batch in batches:
        files = batch.column(0).to_pylist()
        found = [_types(f) for f in files]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(files, pa.string()), pa.array([f and f[0] for f in found], pa.int64()),
                pa.array([f and [{"columna": c, "tipo": t} for c, t in f[1]] for f in found], kind),
            ],
            names=["file", "filas", "columnas"],
        )


def file_schemas(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """``file, filas, columnas``: the rows and the columns with their types of every file.

    Files in a store that Arrow does not know are opened by Spark's own reader, one after the other.
    """
    listed = spark.createDataFrame([(f,) for f in files], "file string")
    read = listed.repartition(max(1, -(-len(files) // FILES_PER_TASK))).mapInArrow(_read_footers, _FOUND)
    # The first file tells whether Arrow knows the store: a table lies in one.
    if not files or fs_known(files[0]):
        return read
    rows = []
    for file in files:
        scan = spark.read.parquet(file)
        rows.append((file, scan.count(), [(f.name, f.dataType.simpleString()) for f in scan.schema]))
    return spark.createDataFrame(rows, _FOUND)


def fs_known(path: str) -> bool:
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False
    return True


def contract_problems(
    spark: SparkSession, files: Sequence[str], contract: StructType, partitions: Sequence[str] = ()
) -> DataFrame:
    """``file, filas, columna, problema, tipo``: a row for each column of each file that departs from the contract.

    ``partitions`` are columns that folder names hold instead of the files. An empty contract or list gives no rows.
    """
    wanted = F.array(*(
        F.struct(F.lit(f.name).alias("columna"), F.lit(f.dataType.simpleString()).alias("tipo"))
        for f in contract if f.name not in partitions
    ))
    has = F.transform("columnas", lambda c: c["columna"])

    def described(column, problem, kind):
        return F.struct(column.alias("columna"), F.lit(problem).alias("problema"), kind.alias("tipo"))

    missing = F.transform(
        F.filter(wanted, lambda w: ~F.array_contains(has, w["columna"])), lambda w: described(w["columna"], MISSING, F.lit(None).cast("string"))
    )
    mistyped = F.transform(
        F.filter("columnas", lambda c: F.exists(wanted, lambda w: (w["columna"] == c["columna"]) & (w["tipo"] != c["tipo"]))),
        lambda c: described(c["columna"], MISTYPED, c["tipo"]),
    )
    extra = F.transform(
        F.filter("columnas", lambda c: ~F.exists(wanted, lambda w: w["columna"] == c["columna"])),
        lambda c: described(c["columna"], EXTRA, c["tipo"]),
    )
    return file_schemas(spark, files).select("file", "filas", F.inline(F.concat(missing, mistyped, extra)))
