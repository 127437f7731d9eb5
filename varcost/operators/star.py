"""The star schema: enriched fact, surrogate keys, and frames in warehouse shape."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varcost import constants as K
from varcost.contracts import DIM_CATALOGUE, FACT, conform_to
from varcost.functions.keys import surrogate_key
from varcost.operators import scd2


@dataclass(frozen=True)
class Run:
    """Lineage of a run (``started`` is UTC): fixed once, so every task writes the same values."""

    started: datetime
    version: str = K.VERSION

    @classmethod
    def now(cls) -> "Run":
        return cls(datetime.now(timezone.utc).replace(tzinfo=None))

    @property
    def run_id(self) -> str:
        return self.started.strftime("%Y%m%dT%H%M%S")

    @property
    def timestamp(self) -> Column:
        # The offset keeps the instant right in any session time zone.
        return F.lit(f"{self.started.isoformat(' ')}+00:00").cast("timestamp")


def enrich(variance: DataFrame, providers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add provider and drug attributes; rows without a match keep NULLs.

    Both dimensions are unique on their key after cleaning, so the row count does not change.
    Give them as scanned from tables, for the reasons in :func:`scd2.as_of_month`.
    """
    provider = providers.select(
        "prestador_id", F.col("nombre").alias("nombre_prestador"), "region", "especialidad"
    )
    drug = catalogue.select("codigo_sns", F.col("nombre").alias("nombre_medicamento"), "precio_ref")
    return variance.join(provider, "prestador_id", "left").join(drug, "codigo_sns", "left")


def with_lineage(df: DataFrame, run: Run) -> DataFrame:
    """Add ``run_id``, ``_calc_ts`` and ``_pipeline_version``."""
    return df.withColumns({
        "run_id": F.lit(run.run_id),
        "_calc_ts": run.timestamp,
        "_pipeline_version": F.lit(run.version),
    })


def fact_key() -> Column:
    """Surrogate key of the fact's grain."""
    return surrogate_key(F.col("prestador_id"), F.col("codigo_sns"), F.col("periodo"))


def catalogue_dimension(clean_catalogue: DataFrame) -> DataFrame:
    """The cleaned catalogue in warehouse shape."""
    keyed = clean_catalogue.withColumn("medicamento_sk", surrogate_key(F.col("codigo_sns")))
    return conform_to(keyed, DIM_CATALOGUE)


def with_dimension_keys(variance: DataFrame, provider_history: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add what the fact needs of the dimensions: ``prestador_sk``, unless it or the version is there, and whether the drug is known."""
    if not {"prestador_sk", scd2.VERSION_SINCE} & set(variance.columns):
        variance = scd2.as_of_month(variance, provider_history)
    drugs = catalogue.select("codigo_sns", F.lit(True).alias("_known_drug"))
    return variance.join(drugs, "codigo_sns", "left")


def as_fact(keyed: DataFrame, run: Run) -> DataFrame:
    """The warehouse shape of rows with dimension keys: row by row, so it may follow the last shuffle of the rows."""
    unknown = {"prestador_sk": K.UNKNOWN_KEY, "medicamento_sk": K.UNKNOWN_KEY}
    if scd2.VERSION_SINCE in keyed.columns:
        keyed = keyed.withColumn("prestador_sk", scd2.version_key(since=scd2.VERSION_SINCE))
    made = keyed.withColumns({
        "medicamento_sk": F.when(F.col("_known_drug"), surrogate_key(F.col("codigo_sns"))),
        "fact_id": fact_key(),
        "periodo_id": F.col("periodo"),
    })
    return conform_to(with_lineage(made, run), FACT, unknown)


def star_fact(
    variance: DataFrame, provider_history: DataFrame, catalogue: DataFrame, run: Run
) -> DataFrame:
    """The fact in warehouse shape.

    The provider key is that of the version in force in the fact's month. Rows without a
    dimension row point to the unknown member, as foreign keys are NOT NULL.
    """
    return as_fact(with_dimension_keys(variance, provider_history, catalogue), run)
