"""Small typed relations for demos and tests, without any files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from varcost.contracts import CATALOGUE, COSTS, PROVIDERS

# Demo rows: N10 occurs twice with different dates, H3 is disabled, H2 gets worse from one month to the
# next after a month below budget, H1 gets better, and every severity band occurs.
CATALOGUE_ROWS = [
    ("N10", "Losartán 50 mg", "Laboratorio Norte", 410.0, "COMP", True, datetime(2023, 7, 1)),
    ("N20", "Insulina glargina", "Laboratorio Andes", 15200.0, "AMP", True, datetime(2023, 7, 1)),
    ("N10", "Losartán 50 mg", "Laboratorio Norte", 432.0, "COMP", True, datetime(2024, 2, 1)),
    ("N30", "Salbutamol aerosol", "Laboratorio Litoral", 5100.0, "AER", True, datetime(2023, 10, 1)),
]
PROVIDER_ROWS = [
    ("H1", "Hospital del Lago", "Medicina interna", "PATAGONIA", True, "33-50001234-9"),
    ("H2", "Sanatorio Los Álamos", "Endocrinología", "CUYO", True, "33-50005678-1"),
    ("H3", "Consultorios del Puerto", "Neumonología", "INTERIOR", False, "33-50009012-4"),
]
COST_ROWS = [
    ("H1", "202403", "N10", 52000.0, 40000.0, 120),
    ("H1", "202403", "N30", 25500.0, 25000.0, 5),
    ("H2", "202403", "N20", 76000.0, 80000.0, 5),
    ("H2", "202403", "N30", 61000.0, 50000.0, 12),
    ("H1", "202404", "N10", 46000.0, 40000.0, 105),
    ("H2", "202404", "N20", 90000.0, 80000.0, 6),
]


def demo_frames(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalogue, providers and costs; a NULL in a required column would be rejected here."""
    return (
        spark.createDataFrame(CATALOGUE_ROWS, CATALOGUE),
        spark.createDataFrame(PROVIDER_ROWS, PROVIDERS),
        spark.createDataFrame(COST_ROWS, COSTS),
    )
