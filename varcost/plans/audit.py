"""Integrity reports run after a load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varcost import constants as K


def orphan_facts(fact: DataFrame, providers: DataFrame) -> DataFrame:
    """How many fact rows name a provider the dimension lacks."""
    # Counted per provider first, so the join never sees a provider's rows one by one.
    per_provider = fact.groupBy("prestador_id").agg(F.count("*").alias("n"))
    orphans = per_provider.join(providers, "prestador_id", "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("huerfanos")).select(
        F.lit("integridad_prestador").alias("test"), "huerfanos"
    )


def orphan_keys(fact: DataFrame) -> DataFrame:
    """How many fact rows point to the unknown member of each dimension, whether or not the natural key is known."""
    unknown = {"prestador_sk": "integridad_prestador_sk", "medicamento_sk": "integridad_medicamento_sk"}
    counts = fact.agg(*(F.count_if(F.col(c) == K.UNKNOWN_KEY).alias(c) for c in unknown))
    return counts.select(F.inline(F.array(*(
        F.struct(F.lit(test).alias("test"), F.col(c).alias("huerfanos")) for c, test in unknown.items()
    ))))


def alerts_without_variance(fact: DataFrame) -> DataFrame:
    """How many alerts are active although the variance is missing."""
    return fact.agg(
        F.count_if(F.col("desvio_pct").isNull() & F.col("alerta_flag")).alias("inconsistencias")
    ).select(F.lit("alertas_sin_desvio").alias("test"), "inconsistencias")


def severity_profile(fact: DataFrame) -> DataFrame:
    """Count, minimum, maximum and average variance per severity, highest average first."""
    return fact.groupBy("severidad").agg(
        F.count("*").alias("cantidad"),
        F.min("desvio_pct").alias("desvio_min"),
        F.max("desvio_pct").alias("desvio_max"),
        F.avg("desvio_pct").alias("desvio_avg"),
    ).orderBy(F.col("desvio_avg").desc_nulls_last())
