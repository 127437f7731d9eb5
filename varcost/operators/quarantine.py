"""Row rules: one pass tags every row with the rules it breaks and routes it to the load or to quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from varcost.functions.joins import join_null_safe
from varcost.operators.quality import FAIL, PASS
from varcost.sinks.scratch import stage

REASONS = "motivos"
REPEATED = "grain"


@dataclass(frozen=True)
class Rule:
    """A condition that a row breaks, and the share of rows that may break it before a run stops."""

    name: str
    broken: Column
    limit: float = 0.0


def required(schema: StructType, limits: Mapping[str, float] | None = None) -> list[Rule]:
    """NOT NULL of every required column of a contract."""
    limits = limits or {}
    return [
        Rule(f"null:{f.name}", F.col(f.name).isNull(), limits.get(f"null:{f.name}", 0.0)) for f in schema if not f.nullable
    ]


def month_rule(column: str = "periodo", limit: float = 0.0) -> Rule:
    """A month that is no ``yyyyMM``; NULL is another rule's business."""
    text = F.col(column)
    valid = text.rlike("^[0-9]{6}$") & F.try_to_date(text, "yyyyMM").isNotNull()
    return Rule(f"month:{column}", text.isNotNull() & ~valid, limit)


def tagged(df: DataFrame, rules: Sequence[Rule], grain: Sequence[str] = ()) -> DataFrame:
    """Add ``motivos``: the names of the rules that the row breaks, in order; ``grain`` if its key is repeated.

    All rows of a repeated key are tagged, since none of them can be told to be the right one. Keys are counted map-side and only the
    repeated ones joined back, so neither a hot key nor a third of all rows being copies gathers rows in a task. They are staged: their
    size is then known before the join, and few of them, as is usual, are broadcast instead of shuffling all rows to meet them.
    """
    broken = [F.when(r.broken, F.lit(r.name)) for r in rules]
    if grain:
        repeated = df.groupBy(*grain).agg(F.count("*").alias("_n")).filter("_n > 1").select(*grain, F.lit(True).alias("_repeated"))
        df = join_null_safe(df, stage(repeated, "repeated"), list(grain))
        broken.append(F.when(F.col("_repeated"), F.lit(REPEATED)))
    return df.withColumn(REASONS, F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")).drop("_repeated")


def routed(tagged_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to load, without their tag, and rows to quarantine, with it. Give a staged frame: both are read from it."""
    good = F.size(REASONS) == 0
    return tagged_rows.filter(good).drop(REASONS), tagged_rows.filter(~good)


def rule_report(tagged_rows: DataFrame, dataset: str, rules: Sequence[Rule], grain_limit: float | None = None) -> DataFrame:
    """A report as of a quality suite: per rule the rows that break it; more than its share of all rows fails. One aggregate."""
    limits = {r.name: r.limit for r in rules} | ({} if grain_limit is None else {REPEATED: grain_limit})
    counts = tagged_rows.agg(
        F.count("*").alias("total"), *(F.count_if(F.array_contains(REASONS, name)).alias(f"n{k}") for k, name in enumerate(limits))
    )
    rows = [
        F.struct(
            F.lit(dataset).alias("df"), F.lit(name).alias("check"), F.col(f"n{k}").cast("double").alias("value"),
            F.lit(float(limit)).alias("threshold"),
            F.when(F.col(f"n{k}") > F.col("total") * limit, FAIL).otherwise(PASS).alias("status"),
        )
        for k, (name, limit) in enumerate(limits.items())
    ]
    return counts.select(F.inline(F.array(*rows)))
