"""The same queries in DuckDB SQL, written from the definitions in FIXTURES.md."""

from __future__ import annotations

COSTS = """
costs AS (
  SELECT 'P' || lpad(l_suppkey::varchar, greatest(4, length(l_suppkey::varchar))::int, '0') AS prestador_id,
         strftime(l_shipdate, '%Y%m') AS periodo,
         upper(p_brand) AS codigo_sns,
         sum((l_extendedprice::decimal(12,2) * (1 - l_discount::decimal(3,2)))::decimal(18,4))::double
           AS costo_real,
         sum(CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 0
                  ELSE l_extendedprice::decimal(12,2) * (0.75 + (l_quantity / 100)::decimal(3,2))
             END::decimal(18,4))::double AS costo_ppto,
         sum(l_quantity)::int AS cantidad
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY ALL
)"""

SCORED = COSTS + """,
scored AS (
  SELECT *,
         CASE WHEN costo_ppto > 0 THEN (costo_real - costo_ppto) / costo_ppto END AS desvio_pct,
         costo_real - costo_ppto AS desvio_abs_ars
  FROM costs
),
banded AS (
  SELECT *,
         abs(desvio_pct) >= 0.15 AS alerta_flag,
         CASE WHEN abs(desvio_pct) >= 0.30 THEN 'CRITICO'
              WHEN abs(desvio_pct) >= 0.15 THEN 'ALTO'
              WHEN abs(desvio_pct) >= 0.05 THEN 'MODERADO'
              ELSE 'NORMAL' END AS severidad
  FROM scored
)"""

FULL = SCORED + """,
lagged AS (
  SELECT *,
         lag(desvio_pct) OVER (PARTITION BY prestador_id, codigo_sns ORDER BY periodo)
           AS desvio_pct_anterior,
         sum(costo_real::decimal(29,9)) OVER (PARTITION BY prestador_id, periodo)::double
           AS costo_real_acum_prestador,
         rank() OVER (PARTITION BY periodo ORDER BY abs(desvio_pct) DESC NULLS LAST)
           AS rank_desvio_periodo
  FROM banded
),
variance AS (
  SELECT *, periodo AS periodo_id,
         CASE WHEN desvio_pct_anterior IS NULL THEN 'NUEVO'
              WHEN desvio_pct > desvio_pct_anterior THEN 'EMPEORA'
              WHEN desvio_pct < desvio_pct_anterior THEN 'MEJORA'
              ELSE 'ESTABLE' END AS tendencia
  FROM lagged
)"""

RAW_CATALOGUE = """
raw_catalogue AS (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN ' ' || lower(p_brand) ELSE p_brand END AS codigo_sns,
         upper(p_name) AS nombre,
         CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS laboratorio,
         CASE WHEN p_partkey % 50 = 0 THEN 0.0::double ELSE p_retailprice END AS precio_ref,
         CASE WHEN p_partkey % 6 <> 0 THEN 'CAPS' END AS unidad_medida,
         p_partkey % 5 <> 0 AS vigente,
         DATE '2020-01-01' + p_size AS fecha_vigencia,
         p_partkey
  FROM part
)"""

INITCAP = (
    "trim(array_to_string(list_transform(string_split(lower({0}), ' '), "
    "lambda w: upper(w[1]) || w[2:]), ' '))"
)

CATALOGUE = RAW_CATALOGUE + f""",
placed_codes AS (
  SELECT * REPLACE (trim(upper(codigo_sns)) AS codigo_sns),
         row_number() OVER (PARTITION BY trim(upper(codigo_sns))
                            ORDER BY fecha_vigencia DESC NULLS LAST, p_partkey DESC) AS place
  FROM raw_catalogue
),
catalogue AS (
  SELECT codigo_sns,
         {INITCAP.format("nombre")} AS nombre,
         coalesce({INITCAP.format("laboratorio")}, 'SIN DATO') AS laboratorio,
         precio_ref,
         coalesce(unidad_medida, 'UN') AS unidad_medida,
         vigente, fecha_vigencia
  FROM placed_codes
  WHERE place = 1 AND precio_ref >= 0.01 AND vigente
)"""

RAW_PROVIDERS = """
raw_providers AS (
  SELECT 'P' || lpad(s_suppkey::varchar, greatest(4, length(s_suppkey::varchar))::int, '0') AS prestador_id,
         CASE WHEN ver = 1 THEN s_name ELSE s_name || ' BIS' END AS nombre,
         'ESP-' || (s_suppkey % 6)::varchar AS especialidad,
         CASE r_name WHEN 'AFRICA' THEN ' gba norte' WHEN 'AMERICA' THEN 'CABA'
                     WHEN 'ASIA' THEN 'Interior ' WHEN 'EUROPE' THEN 'patagonia'
                     ELSE 'ATLANTIS' END AS region,
         CASE WHEN ver = 1 THEN s_acctbal >= 0 ELSE NOT (s_acctbal >= 0) END AS habilitado,
         CASE WHEN s_suppkey % 11 = 0 THEN NULL
              WHEN s_suppkey % 7 = 0 THEN '30-' || s_suppkey::varchar
              ELSE '30-' || lpad(s_suppkey::varchar, greatest(8, length(s_suppkey::varchar))::int, '0')
                   || '-' || (s_suppkey % 10)::varchar END AS cuit,
         ver
  FROM supplier
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN (VALUES (1), (0)) AS copies(ver) ON ver = 1 OR s_suppkey % 10 = 0
)"""

PROVIDERS = RAW_PROVIDERS + """,
deduped AS (
  SELECT * EXCLUDE (place, ver)
  FROM (SELECT *, row_number() OVER (PARTITION BY prestador_id ORDER BY ver DESC) AS place
        FROM raw_providers)
  WHERE place = 1
),
normalised AS (
  SELECT * REPLACE (
           regexp_replace(cuit, '[^0-9]', '', 'g') AS cuit,
           CASE WHEN trim(upper(region)) IN ('GBA NORTE', 'GBA SUR', 'GBA OESTE', 'CABA', 'INTERIOR',
                                             'PATAGONIA', 'NOA', 'NEA', 'CUYO')
                THEN trim(upper(region)) ELSE 'OTRAS' END AS region),
         length(regexp_replace(cuit, '[^0-9]', '', 'g')) = 11 AS cuit_valido
  FROM deduped
),
providers AS (SELECT * FROM normalised WHERE habilitado)"""


def key(*parts: str) -> str:
    """The surrogate key over text expressions."""
    joined = " || '|' || ".join(f"coalesce(length({p})::varchar || ':' || {p}, '-')" for p in parts)
    return f"sha256({joined})"


TRACKED = "nombre, especialidad, region, cuit, cuit_valido, habilitado"

# Gaps and islands: a version is a run of consecutive snapshots with equal tracked columns.
HISTORY = PROVIDERS + f""",
dates(n, day) AS (VALUES (1, DATE '1995-01-01'), (2, DATE '1997-03-15'), (3, DATE '1999-09-01')),
snapshots AS (
  SELECT n, day, prestador_id, nombre, especialidad,
         CASE WHEN n = 3 AND k % 10 = 1 THEN 'CUYO'
              WHEN n = 2 AND k % 5 = 1 THEN 'NOA'
              ELSE region END AS region,
         cuit, cuit_valido,
         n = 1 OR k % 9 <> 2 AS habilitado
  FROM (SELECT *, substr(prestador_id, 2)::bigint AS k FROM normalised), dates
  WHERE n > 1 OR k % 13 <> 3
),
islands AS (
  SELECT *, n - row_number() OVER (PARTITION BY prestador_id, {TRACKED} ORDER BY n) AS island
  FROM snapshots
),
runs AS (
  SELECT prestador_id, {TRACKED}, min(day) AS fecha_inicio, max(n) AS last_n
  FROM islands GROUP BY prestador_id, {TRACKED}, island
),
history AS (
  SELECT {key("prestador_id", "fecha_inicio::varchar")} AS prestador_sk,
         prestador_id, {TRACKED}, fecha_inicio, day AS fecha_fin, day IS NULL AS es_vigente
  FROM runs LEFT JOIN dates ON n = last_n + 1
)"""

HISTORY_OUT = f"""SELECT prestador_sk, prestador_id, {TRACKED}, fecha_inicio::varchar AS fecha_inicio,
       fecha_fin::varchar AS fecha_fin, es_vigente
FROM history"""

MONTHS = """
months AS (
  SELECT strftime(d, '%Y%m') AS periodo_id, year(d)::bigint AS anio, month(d)::bigint AS mes,
         ceil(month(d) / 3.0)::bigint AS trimestre, ceil(month(d) / 6.0)::bigint AS semestre,
         strftime(d, '%B') AS nombre_mes, month(d) = 12 AS es_fin_de_anio,
         month(d) IN (1, 6, 7) AS es_periodo_alta, month(d) IN (3, 6, 9, 12) AS es_periodo_cierre
  FROM (SELECT unnest(generate_series(date_trunc('month', min(l_shipdate)),
                                      date_trunc('month', max(l_shipdate)), interval 1 month)) AS d
        FROM lineitem)
)"""

GRAIN = "prestador_id, periodo, codigo_sns"
CATALOGUE_KEY = key("codigo_sns")
FACT_ID = key("prestador_id", "codigo_sns", "periodo")

STAR = f"""
SELECT {FACT_ID.replace("codigo_sns", "v.codigo_sns").replace("prestador_id", "v.prestador_id")} AS fact_id,
       coalesce(h.prestador_sk, 'UNKNOWN') AS prestador_sk,
       CASE WHEN c.codigo_sns IS NULL THEN 'UNKNOWN'
            ELSE {CATALOGUE_KEY.replace("codigo_sns", "v.codigo_sns")} END AS medicamento_sk,
       v.periodo_id, v.prestador_id, v.codigo_sns, v.periodo,
       v.costo_real, v.costo_ppto, v.cantidad::bigint AS cantidad, v.desvio_pct,
       v.desvio_abs_ars::decimal(38,9)::double AS desvio_abs_ars,
       v.costo_real_acum_prestador, v.alerta_flag, v.severidad, v.tendencia, v.rank_desvio_periodo,
       '20020101T000000' AS run_id, '1.0.0' AS _pipeline_version
FROM variance v
LEFT JOIN history h ON v.prestador_id = h.prestador_id
     AND h.fecha_inicio <= last_day(strptime(v.periodo || '01', '%Y%m%d')::date)
     AND (h.fecha_fin IS NULL OR h.fecha_fin > last_day(strptime(v.periodo || '01', '%Y%m%d')::date))
LEFT JOIN catalogue c ON v.codigo_sns = c.codigo_sns"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def null_rate(dataset: str, table: str, column: str) -> str:
    return f"""SELECT '{dataset}' AS df, 'null_rate:{column}' AS "check", round(rate, 4) AS "value",
       0.02::double AS threshold, CASE WHEN rate <= 0.02 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT coalesce(count(*) FILTER ({column} IS NULL) / nullif(count(*), 0), 0)::double AS rate
      FROM {table})"""


def uniqueness(dataset: str, table: str, columns: str) -> str:
    return f"""SELECT '{dataset}' AS df, 'uniqueness:{columns}' AS "check", round(rate, 4) AS "value",
       0.99::double AS threshold, CASE WHEN rate >= 0.99 THEN 'PASS' ELSE 'WARN' END AS status
FROM (SELECT coalesce((SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {table}))
                      / nullif(count(*), 0), 0)::double AS rate FROM {table})"""


def in_range(dataset: str, table: str) -> str:
    return f"""SELECT '{dataset}' AS df, 'price_range:precio_ref' AS "check", n::double AS "value",
       0.0::double AS threshold, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT count(*) FILTER (precio_ref < 0.01 OR precio_ref > 500000) AS n FROM {table})"""


def catalogue_suite(dataset: str, table: str) -> list[str]:
    return [null_rate(dataset, table, "codigo_sns"), null_rate(dataset, table, "precio_ref"),
            uniqueness(dataset, table, "codigo_sns"), in_range(dataset, table)]


def provider_suite(dataset: str, table: str) -> list[str]:
    return [null_rate(dataset, table, "prestador_id"), null_rate(dataset, table, "nombre"),
            uniqueness(dataset, table, "prestador_id")]


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


RAW_SUITES = catalogue_suite("catalogue_raw", "raw_catalogue") + provider_suite("providers_raw", "raw_providers")
CLEAN_SUITES = catalogue_suite("nomenclador", "catalogue") + provider_suite("prestadores", "providers")

COST_SUITE = [
    null_rate("costos", "costs", "costo_real"), null_rate("costos", "costs", "costo_ppto"),
    uniqueness("costos", "costs", "prestador_id,codigo_sns,periodo"),
]

# The run has no load sequence to break ties with: the remaining columns decide, in order. All
# providers are in its history, each with one version from the beginning.
RUN_DIMENSIONS = RAW_CATALOGUE + """,
catalogue AS (
  SELECT codigo_sns FROM (
    SELECT trim(upper(codigo_sns)) AS codigo_sns, precio_ref, vigente,
           row_number() OVER (
             PARTITION BY trim(upper(codigo_sns))
             ORDER BY fecha_vigencia DESC NULLS LAST, nombre DESC NULLS LAST,
                      laboratorio DESC NULLS LAST, precio_ref DESC NULLS LAST,
                      unidad_medida DESC NULLS LAST, vigente DESC NULLS LAST) AS place
    FROM raw_catalogue)
  WHERE place = 1 AND precio_ref >= 0.01 AND vigente
),""" + RAW_PROVIDERS + f""",
history AS (
  SELECT DISTINCT prestador_id, DATE '1900-01-01' AS fecha_inicio, NULL::date AS fecha_fin,
         {key("prestador_id", "'1900-01-01'")} AS prestador_sk
  FROM raw_providers
)"""

ORACLES = {
    "variance_pct": with_(SCORED) + f"""
SELECT {GRAIN}, costo_real, costo_ppto, desvio_pct, desvio_abs_ars FROM scored""",
    "variance_alert": with_(SCORED) + f"SELECT {GRAIN}, desvio_pct, alerta_flag FROM banded",
    "severity_bands": with_(SCORED) + f"SELECT {GRAIN}, desvio_pct, severidad FROM banded",
    "variance_lag": with_(FULL) + f"SELECT {GRAIN}, desvio_pct, desvio_pct_anterior FROM variance",
    "trend": with_(FULL) + f"SELECT {GRAIN}, desvio_pct_anterior, tendencia FROM variance",
    "variance_rank": with_(FULL) + f"SELECT {GRAIN}, desvio_pct, rank_desvio_periodo FROM variance",
    "provider_month_total": with_(FULL) + f"""
SELECT {GRAIN}, costo_real, costo_real_acum_prestador FROM variance""",
    "variance_full": with_(FULL) + "SELECT * EXCLUDE (periodo_id) FROM variance",
    "active_alerts": with_(FULL) + f"""
SELECT {GRAIN}, costo_real, costo_ppto, desvio_pct, severidad, tendencia
FROM variance WHERE alerta_flag""",
    "scan_contract": with_(RAW_CATALOGUE) + """
SELECT * EXCLUDE (p_partkey) REPLACE (fecha_vigencia::varchar AS fecha_vigencia) FROM raw_catalogue""",
    "contract_nulls": with_(COSTS) + union([
        f" SELECT '{c}' AS columna, count(*) FILTER ({c} IS NULL) AS nulos FROM costs"
        for c in ("prestador_id", "periodo", "codigo_sns", "costo_real", "costo_ppto")
    ]),
    "csv_seed": with_(COSTS) + "SELECT * FROM costs",
    "latest_per_key": with_(CATALOGUE) + """
SELECT codigo_sns, p_partkey, precio_ref, vigente FROM placed_codes WHERE place = 1""",
    "dedup_providers": with_(PROVIDERS) + "SELECT * FROM deduped",
    "clean_catalog": with_(CATALOGUE) + """
SELECT * REPLACE (fecha_vigencia::varchar AS fecha_vigencia), 'nomenclador_nacional' AS _source
FROM catalogue""",
    "clean_providers": with_(PROVIDERS) + "SELECT *, 'listado_prestadores' AS _source FROM providers",
    "dq_null_rate": with_(RAW_CATALOGUE) + union([
        null_rate("catalogue_raw", "raw_catalogue", c)
        for c in ("codigo_sns", "laboratorio", "unidad_medida", "precio_ref")
    ]),
    "dq_uniqueness": with_(PROVIDERS) + union([
        uniqueness("providers_raw", "raw_providers", "prestador_id"),
        uniqueness("providers_clean", "providers", "prestador_id"),
    ]),
    "dq_range": with_(CATALOGUE) + union([
        in_range("catalogue_raw", "raw_catalogue"), in_range("catalogue_clean", "catalogue"),
    ]),
    "dq_catalog": with_(CATALOGUE) + union(catalogue_suite("nomenclador", "catalogue")),
    "dq_providers": with_(PROVIDERS) + union(provider_suite("prestadores", "providers")),
    "dq_costs": with_(COSTS) + union(COST_SUITE),
    "dq_summary": with_(CATALOGUE, PROVIDERS) + f"""
SELECT df, count(*) AS total_checks, count(*) FILTER (status = 'FAIL') AS failed,
       count(*) FILTER (status = 'WARN') AS warned,
       CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS overall
FROM ({union(RAW_SUITES + CLEAN_SUITES)}) GROUP BY df""",
    "dq_audit": with_(CATALOGUE, PROVIDERS) + f"""
SELECT *, '20020101T000000' AS run_id FROM ({union(CLEAN_SUITES)})""",
    "dq_report_file": with_(RAW_CATALOGUE, COSTS) + f"""
SELECT df, count(*) AS total_checks, count(*) FILTER (status = 'FAIL') AS failed,
       count(*) FILTER (status = 'WARN') AS warned,
       CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS overall,
       '2002-01-01T00:00:00' AS run_ts
FROM ({union(catalogue_suite("catalogue_raw", "raw_catalogue") + COST_SUITE)}) GROUP BY df""",
    "dim_tiempo": with_(MONTHS) + "SELECT * FROM months",
    "fact_enriched": with_(FULL, PROVIDERS, CATALOGUE) + """
SELECT v.* EXCLUDE (periodo_id), p.nombre AS nombre_prestador, p.region, p.especialidad,
       c.nombre AS nombre_medicamento, c.precio_ref
FROM variance v
LEFT JOIN providers p ON v.prestador_id = p.prestador_id
LEFT JOIN catalogue c ON v.codigo_sns = c.codigo_sns""",
    "surrogate_keys": with_(COSTS) + f"""
SELECT {GRAIN}, {FACT_ID} AS fact_id, {CATALOGUE_KEY} AS medicamento_sk FROM costs""",
    "fact_grain": with_(COSTS) + """
SELECT prestador_id, periodo, count(*) AS filas FROM costs GROUP BY ALL HAVING count(*) > 1""",
    "fact_star": with_(FULL, CATALOGUE, HISTORY) + STAR,
    "sink_roundtrip": with_(FULL, CATALOGUE, HISTORY) + STAR,
    "monthly_run": with_(FULL, RUN_DIMENSIONS) + STAR,
    "dim_catalog": with_(CATALOGUE) + f"""
SELECT {CATALOGUE_KEY} AS medicamento_sk, * REPLACE (fecha_vigencia::varchar AS fecha_vigencia),
       'nomenclador_nacional' AS _source
FROM catalogue""",
    "scd2_history": with_(HISTORY) + HISTORY_OUT,
    "scd2_incremental": with_(HISTORY) + HISTORY_OUT,
    "scd2_current": with_(HISTORY) + HISTORY_OUT + " WHERE es_vigente",
    "pit_join": with_(COSTS, HISTORY) + """
SELECT c.prestador_id, c.periodo, c.codigo_sns, h.prestador_sk, h.region, h.habilitado,
       h.fecha_inicio::varchar AS fecha_inicio
FROM costs c LEFT JOIN history h ON c.prestador_id = h.prestador_id
     AND h.fecha_inicio <= last_day(strptime(c.periodo || '01', '%Y%m%d')::date)
     AND (h.fecha_fin IS NULL OR h.fecha_fin > last_day(strptime(c.periodo || '01', '%Y%m%d')::date))""",
    "period_summary": with_(FULL, MONTHS) + """
SELECT v.periodo_id, m.nombre_mes, m.anio, m.trimestre,
       count(DISTINCT v.prestador_id) AS total_prestadores,
       count(*) AS total_transacciones,
       sum(costo_real::decimal(29,9))::double AS costo_real_total,
       sum(costo_ppto::decimal(29,9))::double AS costo_ppto_total,
       sum(desvio_abs_ars::decimal(29,9))::double AS desvio_total_ars,
       sum(desvio_abs_ars::decimal(29,9))::double
         / nullif(sum(costo_ppto::decimal(29,9))::double, 0) AS desvio_pct_consolidado,
       count(*) FILTER (alerta_flag) AS total_alertas,
       count(*) FILTER (severidad = 'CRITICO') AS alertas_criticas,
       count(*) FILTER (tendencia = 'EMPEORA') AS tendencias_negativas
FROM variance v LEFT JOIN months m ON v.periodo_id = m.periodo_id
GROUP BY ALL""",
    "top_providers": with_(FULL, HISTORY) + """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY periodo_id
                               ORDER BY abs(desvio_pct_prestador) DESC NULLS LAST, prestador_id)
              AS rank_periodo
  FROM (
    SELECT v.prestador_id, h.nombre AS nombre_prestador, h.region, h.especialidad, v.periodo_id,
           sum(costo_real::decimal(29,9))::double AS costo_real,
           sum(costo_ppto::decimal(29,9))::double AS costo_ppto,
           sum(desvio_abs_ars::decimal(29,9))::double
             / nullif(sum(costo_ppto::decimal(29,9))::double, 0) AS desvio_pct_prestador,
           count(*) FILTER (severidad = 'CRITICO') AS eventos_criticos,
           max(tendencia) AS tendencia_predominante
    FROM variance v LEFT JOIN history h ON v.prestador_id = h.prestador_id AND h.es_vigente
    GROUP BY ALL
  )
) WHERE rank_periodo <= 20""",
    "smoke_orphans": with_(COSTS, PROVIDERS) + """
SELECT 'integridad_prestador' AS test, count(*) AS huerfanos
FROM costs c LEFT JOIN providers p ON c.prestador_id = p.prestador_id
WHERE p.prestador_id IS NULL""",
    "smoke_alerts": with_(SCORED) + """
SELECT 'alertas_sin_desvio' AS test,
       count(*) FILTER (desvio_pct IS NULL AND alerta_flag) AS inconsistencias
FROM banded""",
    "severity_profile": with_(SCORED) + """
SELECT severidad, count(*) AS cantidad, min(desvio_pct) AS desvio_min, max(desvio_pct) AS desvio_max,
       round(avg(desvio_pct), 6) AS desvio_avg
FROM banded GROUP BY severidad""",
}
