"""Reconciliation of the budget seed with the actuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a key's comparison may find.
MATCHED, DIFFERENT = "IGUAL", "DIFERENTE"
ONLY_SEED, ONLY_ACTUAL = "SOLO_PRESUPUESTO", "SOLO_REAL"
REPEATED = "REPETIDO"

GRAIN = ("prestador_id", "codigo_sns", "periodo")


def budget_reconcile(
    seed: DataFrame,
    actuals: DataFrame,
    keys: Sequence[str] = GRAIN,
    seed_amount: str = "costo_ppto",
    actual_amount: str = "costo_ppto",
    tolerance: float = 0.0,
) -> DataFrame:
    """One row per key of either side: both amounts, rows on each side, their difference and ``estado``.

    Each side is counted and added up per key first, in decimals, so a key that is repeated on both sides gives one row, not their
    product, and a hot key is combined map-side. NULL keys meet NULL keys. A repeated key is named as such whatever its
    amounts; amounts that are both NULL are equal, one NULL is a difference.
    """

    def side(df: DataFrame, amount: str, name: str) -> DataFrame:
        return df.groupBy(*(F.col(k).alias(f"_{name}_{k}") for k in keys)).agg(
            F.count("*").alias(f"filas_{name}"), F.sum(F.col(amount).cast("decimal(29,9)")).alias(f"monto_{name}")
        )

    left, right = side(seed, seed_amount, "presupuesto"), side(actuals, actual_amount, "real")
    same = [F.col(f"_presupuesto_{k}").eqNullSafe(F.col(f"_real_{k}")) for k in keys]
    condition = same[0]
    for other in same[1:]:
        condition &= other
    both = left.join(right, condition, "full")
    in_seed, in_actual = F.col("filas_presupuesto").isNotNull(), F.col("filas_real").isNotNull()
    a, b = F.col("monto_presupuesto"), F.col("monto_real")
    close = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.lit(tolerance).cast("decimal(29,9)"), F.lit(False))
    state = (
        F.when((F.col("filas_presupuesto") > 1) | (F.col("filas_real") > 1), REPEATED)
        .when(~in_seed, ONLY_ACTUAL).when(~in_actual, ONLY_SEED).when(close, MATCHED).otherwise(DIFFERENT)
    )
    return both.select(
        *(F.when(in_seed, F.col(f"_presupuesto_{k}")).otherwise(F.col(f"_real_{k}")).alias(k) for k in keys),
        F.coalesce("filas_presupuesto", F.lit(0)).alias("filas_presupuesto"), F.coalesce("filas_real", F.lit(0)).alias("filas_real"),
        a.cast("double").alias("monto_presupuesto"), b.cast("double").alias("monto_real"),
        (b - a).cast("double").alias("diferencia"), state.alias("estado"),
    )


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    """Keys and amounts per state."""
    return reconciled.groupBy("estado").agg(
        F.count("*").alias("claves"),
        F.sum(F.col("diferencia").cast("decimal(29,9)")).cast("double").alias("diferencia"),
    )
