"""Summary reports over the fact.

Both aggregate the fact before joining a dimension, so a join sees one row per month or per
provider and month instead of every fact row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varcost import constants as K
from varcost.functions.variance import money_sum, ratio_of_sums


def period_summary(fact: DataFrame, months: DataFrame) -> DataFrame:
    """One row per month: providers, rows, money, consolidated variance and alert counts."""
    totals = fact.groupBy("periodo_id").agg(
        F.count_distinct("prestador_id").alias("total_prestadores"),
        F.count("*").alias("total_transacciones"),
        money_sum(F.col("costo_real")).alias("costo_real_total"),
        money_sum(F.col("costo_ppto")).alias("costo_ppto_total"),
        money_sum(F.col("desvio_abs_ars")).alias("desvio_total_ars"),
        ratio_of_sums(F.col("desvio_abs_ars"), F.col("costo_ppto")).alias("desvio_pct_consolidado"),
        F.count_if("alerta_flag").alias("total_alertas"),
        F.count_if(F.col("severidad") == K.SEVERITY_BANDS[0][0]).alias("alertas_criticas"),
        F.count_if(F.col("tendencia") == K.TREND_WORSE).alias("tendencias_negativas"),
    )
    labels = months.select("periodo_id", "nombre_mes", "anio", "trimestre")
    return totals.join(labels, "periodo_id", "left").select(
        "periodo_id", "nombre_mes", "anio", "trimestre", *totals.columns[1:]
    )


def top_providers(fact: DataFrame, provider_history: DataFrame, top: int = K.TOP_PROVIDERS) -> DataFrame:
    """The providers of each month with the largest consolidated variance either way.

    The rank filter becomes a group limit that every task applies before the shuffle, so a month
    of any size sends at most ``top`` rows per task. Ties fall to the lower provider id.
    """
    per_provider = fact.groupBy("periodo_id", "prestador_id").agg(
        money_sum(F.col("costo_real")).alias("costo_real"),
        money_sum(F.col("costo_ppto")).alias("costo_ppto"),
        ratio_of_sums(F.col("desvio_abs_ars"), F.col("costo_ppto")).alias("desvio_pct_prestador"),
        F.count_if(F.col("severidad") == K.SEVERITY_BANDS[0][0]).alias("eventos_criticos"),
        F.max("tendencia").alias("tendencia_predominante"),
    )
    largest = Window.partitionBy("periodo_id").orderBy(
        F.abs("desvio_pct_prestador").desc_nulls_last(), F.col("prestador_id")
    )
    ranked = per_provider.withColumn("rank_periodo", F.row_number().over(largest)).filter(
        F.col("rank_periodo") <= top
    )
    provider = provider_history.filter("es_vigente").select(
        "prestador_id", F.col("nombre").alias("nombre_prestador"), "region", "especialidad"
    )
    return ranked.join(provider, "prestador_id", "left").select(
        "prestador_id", "nombre_prestador", "region", "especialidad", "periodo_id",
        "costo_real", "costo_ppto", "desvio_pct_prestador", "eventos_criticos",
        "tendencia_predominante", F.col("rank_periodo").cast("long").alias("rank_periodo"),
    )


def create_views(fact: DataFrame, months: DataFrame, provider_history: DataFrame) -> None:
    """Register both reports as temporary views; lasting ones are in ``sinks.warehouse``."""
    period_summary(fact, months).createOrReplaceTempView("v_resumen_desvios_periodo")
    top_providers(fact, provider_history).createOrReplaceTempView("v_top_prestadores_desvio")
