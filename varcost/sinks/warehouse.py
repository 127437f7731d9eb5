"""The catalogue's side of the warehouse: tables that point to what a run has written, and lasting views over them.

A run writes its dimensions as new versions, each in a folder of its own. A table is swapped by pointing it to
that folder, so readers see the old content or the new one, whole, and never several versions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from varcost import constants as K
from varcost.contracts import WAREHOUSE
from varcost.sinks.ddl import _text, create_table_sql

# Names of the views.
SUMMARY_VIEW, TOP_VIEW = "v_resumen_desvios_periodo", "v_top_prestadores_desvio"

_CRITICAL = K.SEVERITY_BANDS[0][0]


def _money(column: str) -> str:
    return f"CAST(SUM(CAST({column} AS DECIMAL(29,9))) AS DOUBLE)"


def summary_view_sql(database: str) -> str:
    """The summary per month; the fact is aggregated before the calendar is joined."""
    return f"""
CREATE OR REPLACE VIEW `{database}`.`{SUMMARY_VIEW}` COMMENT 'Budget variance per month' AS
SELECT t.periodo_id, m.nombre_mes, m.anio, m.trimestre, t.total_prestadores, t.total_transacciones, t.costo_real_total,
       t.costo_ppto_total, t.desvio_total_ars, try_divide(t.desvio_total_ars, t.costo_ppto_total) AS desvio_pct_consolidado,
       t.total_alertas, t.alertas_criticas, t.tendencias_negativas
FROM (
  SELECT periodo_id, COUNT(DISTINCT prestador_id) AS total_prestadores, COUNT(*) AS total_transacciones,
         {_money("costo_real")} AS costo_real_total, {_money("costo_ppto")} AS costo_ppto_total,
         {_money("desvio_abs_ars")} AS desvio_total_ars, COUNT_IF(alerta_flag) AS total_alertas,
         COUNT_IF(severidad = '{_CRITICAL}') AS alertas_criticas, COUNT_IF(tendencia = '{K.TREND_WORSE}') AS tendencias_negativas
  FROM `{database}`.`fact_costos_prestacionales` GROUP BY periodo_id
) t LEFT JOIN `{database}`.`dim_tiempo` m ON t.periodo_id = m.periodo_id"""


def top_view_sql(database: str, top: int = K.TOP_PROVIDERS) -> str:
    """The providers of each month with the largest variance either way; the rank's filter limits groups before the shuffle."""
    return f"""
CREATE OR REPLACE VIEW `{database}`.`{TOP_VIEW}` COMMENT 'Providers with the largest variance per month' AS
WITH per_provider AS (
  SELECT periodo_id, prestador_id, {_money("costo_real")} AS costo_real, {_money("costo_ppto")} AS costo_ppto,
         try_divide({_money("desvio_abs_ars")}, {_money("costo_ppto")}) AS desvio_pct_prestador,
         COUNT_IF(severidad = '{_CRITICAL}') AS eventos_criticos, MAX(tendencia) AS tendencia_predominante
  FROM `{database}`.`fact_costos_prestacionales` GROUP BY periodo_id, prestador_id
),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY periodo_id ORDER BY ABS(desvio_pct_prestador) DESC NULLS LAST, prestador_id) AS place
  FROM per_provider
)
SELECT r.prestador_id, p.nombre AS nombre_prestador, p.region, p.especialidad, r.periodo_id, r.costo_real, r.costo_ppto,
       r.desvio_pct_prestador, r.eventos_criticos, r.tendencia_predominante, CAST(r.place AS BIGINT) AS rank_periodo
FROM ranked r
LEFT JOIN (SELECT prestador_id, nombre, region, especialidad FROM `{database}`.`dim_prestador` WHERE es_vigente) p
  ON r.prestador_id = p.prestador_id
WHERE r.place <= {top}"""


def publish(spark: SparkSession, database: str, locations: dict[str, str]) -> None:
    """Create what is missing, point every table to its folder, and create or replace both views.

    ``locations`` holds the folder of each warehouse table that was written. Running it again changes nothing.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, folder in locations.items():
        spec, table = WAREHOUSE[name], f"`{database}`.`{name}`"
        spark.sql(create_table_sql(spec, database, folder))
        if spec.partition_by:
            # Months are folders of one location; a run's new ones are added to the catalogue.
            spark.sql(f"MSCK REPAIR TABLE {table}")
        else:
            spark.sql(f"ALTER TABLE {table} SET LOCATION {_text(folder)}")
        spark.catalog.refreshTable(f"{database}.{name}")
    if set(WAREHOUSE) <= set(locations):
        spark.sql(summary_view_sql(database))
        spark.sql(top_view_sql(database))
