"""The queries of the loading features in DuckDB SQL."""

from __future__ import annotations

from workload.oracles import COSTS, FULL, GRAIN, HISTORY, HISTORY_OUT, MONTHS, ORACLES as CORE, SCORED, union, with_

# A number from 0 to 96 for each provider and month, by which defects are planted.
MARK = "(substr(prestador_id, 2)::bigint * 31 + periodo::bigint) % 97"

PLANTED = COSTS + f""",
planted AS (
  SELECT CASE WHEN mark NOT IN (5, 17) THEN prestador_id END AS prestador_id,
         CASE WHEN mark IN (7, 17) THEN '999999' ELSE periodo END AS periodo,
         codigo_sns, costo_real,
         CASE WHEN mark <> 11 THEN costo_ppto END AS costo_ppto
  FROM (SELECT *, {MARK} AS mark FROM costs) JOIN (VALUES (1), (2)) AS copies(copy) ON copy = 1 OR mark = 13
),
reasons AS (
  SELECT *, concat_ws(',', CASE WHEN prestador_id IS NULL THEN 'null:prestador_id' END,
                           CASE WHEN costo_ppto IS NULL THEN 'null:costo_ppto' END,
                           CASE WHEN try_strptime(periodo, '%Y%m') IS NULL THEN 'month:periodo' END,
                           CASE WHEN count(*) OVER (PARTITION BY {GRAIN}) > 1 THEN 'grain' END) AS motivos
  FROM planted
)"""

SEED = COSTS + f""",
seed AS (
  SELECT prestador_id, periodo, CASE WHEN mark = 7 THEN 'BRAND#99' ELSE codigo_sns END AS codigo_sns,
         CASE WHEN mark = 11 THEN costo_ppto + 100 ELSE costo_ppto END AS costo_ppto
  FROM (SELECT *, {MARK} AS mark FROM costs) JOIN (VALUES (1), (2)) AS copies(copy) ON copy = 1 OR mark = 13
  WHERE mark <> 5
),
sides AS (
  SELECT {GRAIN}, count(*) FILTER (side = 1) AS filas_presupuesto, count(*) FILTER (side = 2) AS filas_real,
         sum(amount::decimal(29,9)) FILTER (side = 1) AS a, sum(amount::decimal(29,9)) FILTER (side = 2) AS b
  FROM (SELECT {GRAIN}, costo_ppto AS amount, 1 AS side FROM seed
        UNION ALL SELECT {GRAIN}, costo_ppto, 2 FROM costs)
  GROUP BY {GRAIN}
)"""

PROBLEMS = (("missing", "costo_ppto", "missing", "NULL"), ("mistyped", "cantidad", "mistyped", "'bigint'"), ("extra", "nota", "extra", "'string'"))


def _level(name: str, label: str) -> str:
    return f"""SELECT '{name}' AS nivel, {label} AS periodo, count(DISTINCT prestador_id) AS prestadores
FROM costs JOIN months ON periodo = periodo_id GROUP BY ALL"""


ORACLES = {
    "contract_files": with_(COSTS) + union([
        f"""SELECT '{folder}' AS carpeta, '{column}' AS columna, '{problem}' AS problema, {kind}::varchar AS tipo, count(*) AS filas
FROM costs""" for folder, column, problem, kind in PROBLEMS
    ]),
    "trend_incremental": with_(FULL) + f"SELECT {GRAIN}, desvio_pct, tendencia FROM variance",
    "cost_quarantine": with_(PLANTED) + f"""
SELECT {GRAIN}, costo_real, costo_ppto, CASE WHEN motivos = '' THEN 'fact' ELSE 'quarantine' END AS destino, motivos
FROM reasons""",
    "warehouse_views": f"""
SELECT 'resumen' AS vista, periodo_id, NULL::varchar AS prestador_id, total_transacciones AS n, costo_real_total AS costo_real,
       desvio_pct_consolidado AS desvio
FROM ({CORE["period_summary"]})
UNION ALL
SELECT 'top', periodo_id, prestador_id, rank_periodo, costo_real, desvio_pct_prestador FROM ({CORE["top_providers"]})""",
    "scd2_bucketed": with_(HISTORY) + HISTORY_OUT,
    "ledger_rerun": with_(SCORED) + f"SELECT {GRAIN}, desvio_pct, severidad FROM banded",
    "clustered_scan": with_(COSTS) + union([
        f"SELECT '{name}' AS filtro, {GRAIN}, costo_real FROM costs WHERE {condition}" for name, condition in (
            ("provider", "prestador_id BETWEEN 'P0003' AND 'P0009'"), ("drug", "codigo_sns = 'BRAND#23'"),
            ("month", "periodo LIKE '1996%'"),
        )
    ]),
    "period_rollup": with_(COSTS, MONTHS) + union([
        _level("mes", "periodo"), _level("trimestre", "anio::varchar || 'T' || trimestre::varchar"), _level("anio", "anio::varchar"),
    ]),
    "pit_merge": CORE["pit_join"],
    "budget_reconcile": with_(SEED) + f"""
SELECT {GRAIN}, filas_presupuesto, filas_real, round(a::double, 4) AS monto_presupuesto, round(b::double, 4) AS monto_real,
       round((b - a)::double, 4) AS diferencia,
       CASE WHEN filas_presupuesto > 1 OR filas_real > 1 THEN 'REPETIDO' WHEN filas_presupuesto = 0 THEN 'SOLO_REAL'
            WHEN filas_real = 0 THEN 'SOLO_PRESUPUESTO' WHEN abs(a - b) <= 0.005 THEN 'IGUAL' ELSE 'DIFERENTE' END AS estado
FROM sides""",
}
