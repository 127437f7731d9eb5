"""The month dimension."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varcost import constants as K


def month_of(col: Column) -> Column:
    """``yyyyMM`` of a date or timestamp."""
    return F.date_format(col, "yyyyMM")


def calendar_months(span: DataFrame) -> DataFrame:
    """One row per month of ``span``, a one-row frame with the dates ``first`` and ``last``."""
    first_day = F.col("d")
    month = F.month(first_day)
    return span.select(
        F.explode(F.expr("sequence(trunc(first, 'MM'), trunc(last, 'MM'), interval 1 month)")).alias("d")
    ).select(
        month_of(first_day).alias("periodo_id"),
        F.year(first_day).cast("long").alias("anio"),
        month.cast("long").alias("mes"),
        F.quarter(first_day).cast("long").alias("trimestre"),
        F.ceil(month / 6).cast("long").alias("semestre"),
        F.date_format(first_day, "MMMM").alias("nombre_mes"),
        (month == 12).alias("es_fin_de_anio"),
        month.isin(*K.HIGH_SEASON_MONTHS).alias("es_periodo_alta"),
        month.isin(*K.CLOSING_MONTHS).alias("es_periodo_cierre"),
    )


def calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """The calendar between two given dates."""
    return calendar_months(spark.createDataFrame([(first, last)], "first date, last date"))


def calendar_of(df: DataFrame, day: Column) -> DataFrame:
    """The calendar that spans the dates found in a frame."""
    return calendar_months(
        df.agg(F.min(day).cast("date").alias("first"), F.max(day).cast("date").alias("last"))
    )
