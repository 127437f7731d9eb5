"""Groups that hold most of the rows are split, and results stay whole.

The size thresholds of adaptive execution are lowered so that small data counts as skewed.
"""

from contextlib import contextmanager
from datetime import date

import pytest
from conftest import ran_plan
from pyspark.sql import Window
from pyspark.sql import functions as F

from varcost.operators import scd2, star, variance
from varcost.plans import audit
from varcost.sinks.scratch import stage
from varcost.sinks.writers import write_table

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    "spark.sql.shuffle.partitions": "16",
}


@contextmanager
def conf(spark, settings):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.fixture(scope="module")
def costs(spark, tmp_path_factory):
    """Provider P0 and one month hold most rows, and most rows share one variance."""
    n = 60_000
    rows = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 < 2, "P0").otherwise(F.concat(F.lit("P"), F.col("id") % 50)).alias("prestador_id"),
        F.when(F.col("id") % 4 < 3, "202401").otherwise("202402").alias("periodo"),
        F.format_string("M%06d", "id").alias("codigo_sns"),
        F.when(F.col("id") % 3 < 2, 120.0).otherwise(100.0 + (F.col("id") * 7919 % 1000) / 10).alias("costo_real"),
        F.lit(100.0).alias("costo_ppto"),
        F.lit(1).alias("cantidad"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("pad"),
    )
    path = str(tmp_path_factory.mktemp("skew") / "costs")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_rank_join_splits_the_hot_value(spark, costs):
    scored = variance.with_ratio(costs)
    w = Window.partitionBy("periodo").orderBy(F.abs("desvio_pct").desc_nulls_last())
    want = scored.withColumn("rank_desvio_periodo", F.rank().over(w).cast("long"))
    with conf(spark, SMALL):
        got = variance.with_month_rank(scored)
        assert "skew=true" in ran_plan(got)
    assert same(got.select("codigo_sns", "rank_desvio_periodo"), want.select("codigo_sns", "rank_desvio_periodo"))


def test_total_join_splits_the_hot_provider(spark, costs):
    w = Window.partitionBy("prestador_id", "periodo")
    want = costs.withColumn("t", F.sum(F.col("costo_real").cast("decimal(29,9)")).over(w).cast("double"))
    with conf(spark, SMALL):
        got = variance.with_provider_total(costs)
        assert "skew=true" in ran_plan(got)
    assert same(got.select("codigo_sns", F.col("costo_real_acum_prestador").alias("t")), want.select("codigo_sns", "t"))


def test_whole_variance_splits_both_joins(spark, costs):
    with conf(spark, SMALL):
        got = variance.budget_variance(costs)
        assert ran_plan(got).count("skew=true") == 2
    assert got.count() == costs.count()


def test_dimension_joins_split_the_hot_provider(spark, costs):
    providers = costs.select("prestador_id").distinct().select(
        "prestador_id", F.lit("n").alias("nombre"), F.lit("r").alias("region"), F.lit("e").alias("especialidad"),
        F.lit(None).cast("string").alias("cuit"), F.lit(None).cast("boolean").alias("cuit_valido"),
        F.lit(True).alias("habilitado"),
    )
    # Read from tables, as in the monthly run: see ``scd2.as_of_month``.
    history = stage(scd2.history({date(2020, 1, 1): providers}), "history")
    providers = stage(providers, "providers")
    drugs = costs.select("codigo_sns", F.lit("d").alias("nombre"), F.lit(1.0).alias("precio_ref"))
    with conf(spark, SMALL):
        in_force = scd2.as_of_month(costs, history)
        assert "skew=true" in ran_plan(in_force)
        enriched = star.enrich(costs, providers, drugs)
        assert "skew=true" in ran_plan(enriched)
    assert in_force.count() == enriched.count() == costs.count()
    assert in_force.filter("prestador_sk IS NULL").count() == 0


def test_orphan_join_never_meets_the_hot_provider_row_by_row(spark, costs):
    with conf(spark, SMALL):
        plan = ran_plan(audit.orphan_facts(costs, costs.filter("prestador_id <> 'P0'").select("prestador_id").distinct()))
    join = plan.index("LeftAnti")
    assert "HashAggregate" in plan[join:]


def test_a_large_month_is_written_by_several_tasks(spark, costs, tmp_path):
    path = tmp_path / "t"
    with conf(spark, {**SMALL, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256KB"}):
        write_table(costs, str(path), partition_by=["periodo"], cluster_by=["prestador_id"])
    files = list((path / "periodo=202401").glob("*.parquet"))
    assert len(files) > 1
    assert spark.read.parquet(str(path)).count() == costs.count()
