"""Cleaning of the raw catalogue and provider tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varcost import constants as K
from varcost.functions import text


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_first: Sequence[str]) -> DataFrame:
    """Keep one row per key: the greatest by ``newest_first``, compared column by column.

    ``row_number() = 1`` becomes a group limit that each task applies before the shuffle, so a
    key holding a large share of the rows sends one row per input task, not all of them.
    """
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in newest_first))
    return df.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").drop("_place")


def _total_order(df: DataFrame, keys: Sequence[str], first: Sequence[str]) -> list[str]:
    """``first``, then every other column: rows still tied are identical."""
    return [*first, *(c for c in df.columns if c not in keys and c not in first)]


def _audited(run_ts: Column | None, source: str) -> dict[str, Column]:
    return {"_ingestion_ts": F.current_timestamp() if run_ts is None else run_ts, "_source": F.lit(source)}


def clean_catalogue(
    raw: DataFrame, tie_breakers: Sequence[str] = (), run_ts: Column | None = None
) -> DataFrame:
    """Latest valid state of every catalogue code.

    Codes are normalised before they are deduplicated, so spellings of one code compete with
    each other. The latest state wins even when it is not valid: then the code disappears.
    """
    normal = raw.withColumn("codigo_sns", text.code(F.col("codigo_sns")))
    order = _total_order(raw, ["codigo_sns"], ["fecha_vigencia", *tie_breakers])
    return (
        latest_per_key(normal, ["codigo_sns"], order)
        .filter((F.col("precio_ref") >= K.MIN_PRICE) & F.col("vigente"))
        .withColumns({
            "nombre": text.title(F.col("nombre")),
            "laboratorio": F.coalesce(text.title(F.col("laboratorio")), F.lit(K.NO_LABORATORY)),
            "unidad_medida": F.coalesce(F.col("unidad_medida"), F.lit(K.NO_UNIT)),
            **_audited(run_ts, K.SOURCE_CATALOGUE),
        })
        .drop(*tie_breakers)
    )


def dedup_providers(raw: DataFrame, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """One row per provider, chosen by a total order and so the same on every run."""
    order = _total_order(raw, ["prestador_id"], list(tie_breakers))
    return latest_per_key(raw, ["prestador_id"], order).drop(*tie_breakers)


def normalise_providers(raw: DataFrame, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Deduplicated providers, enabled or not, with normalised region and tax id."""
    tax_id = text.digits(F.col("cuit"))
    return dedup_providers(raw, tie_breakers).withColumns({
        "cuit": tax_id,
        "cuit_valido": F.length(tax_id) == K.TAX_ID_DIGITS,
        "region": text.official_region(F.col("region")),
    })


def clean_providers(
    raw: DataFrame, tie_breakers: Sequence[str] = (), run_ts: Column | None = None
) -> DataFrame:
    """The enabled providers, normalised; invalid tax ids are flagged, not dropped."""
    return (
        normalise_providers(raw, tie_breakers)
        .filter("habilitado")
        .withColumns(_audited(run_ts, K.SOURCE_PROVIDERS))
    )
