"""Rows that one shuffle both ranks and lays out by month; what is known of repeats and versions does not travel again."""

from dataclasses import replace
from datetime import date, datetime

import pytest
from conftest import plan_of, ran_plan
from pyspark.sql import Window
from pyspark.sql import functions as F

from varcost.functions import variance as V
from varcost.operators import carry, quality, quarantine, ranking, scd2, star, variance
from varcost.plans import trends
from varcost.sinks.scratch import stage
from varcost.sinks.writers import write_table
from workload import adapters

RUN = star.Run(datetime(2024, 5, 1))
SCHEMA = "prestador_id string, periodo string, codigo_sns string, costo_real double, costo_ppto double, cantidad int"


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def costs(spark):
    """Months of very different size; one value, and no value, in very many rows; values next to each other, NaN, infinity, NULL keys."""
    data = []
    for k in range(3000):
        real = (100.0, 130.0 + k * 1e-9, 100.0 + k, 250.0, float(k % 7), float("nan") if k % 2 else float("inf"))[k % 6]
        data.append((f"P{k % 5}" if k % 11 else None, ("202401", "202401", "202401", "202402", None)[k % 5], f"M{k}", real, 0.0 if k % 4 == 0 else 100.0, 1))
    data += [("P1", "202403", f"M{k}", 90.0 + k, 100.0, 1) for k in range(3)]
    return stage(spark.createDataFrame(data, SCHEMA), "costs")


def windowed(df):
    month = Window.partitionBy("periodo").orderBy(F.abs("desvio_pct").desc_nulls_last())
    return variance.with_ratio(df).withColumn("rank_desvio_periodo", F.rank().over(month).cast("long")).drop("desvio_pct", "desvio_abs_ars")


@pytest.mark.parametrize("rows", [10, 100, 10_000])
def test_ranks_in_slices_are_ranks(costs, rows):
    assert same(variance.ranked_by_month(costs, costs, rows=rows).select(*costs.columns, "rank_desvio_periodo"), windowed(costs))


def test_slices_are_small_but_for_rows_of_one_value(costs):
    magnitude = F.abs(variance.observed(costs))
    slices = ranking.rank_slices(costs, "periodo", magnitude, rows=50)
    held = (
        ranking._coded(costs.withColumn("_score", ranking.scored(magnitude)), "_score", sum(ranking.SLICE_BITS)).alias("v")
        .join(slices.alias("s"), F.expr("v.periodo <=> s.periodo AND _code >= _low AND (_high IS NULL OR _code < _high)"))
        .groupBy("s.periodo", "_start", "_parts").agg(F.count("*").alias("n"), F.count_distinct("_score").alias("values"))
    ).collect()
    assert sum(r["n"] for r in held) == costs.count()
    assert any(r["_parts"] > 1 for r in held)
    assert all(r["n"] < 100 or r["values"] == 1 and r["n"] <= 50 * r["_parts"] for r in held)
    assert sum(r["periodo"] == "202403" for r in held) == 1


def test_one_shuffle_ranks_rows_and_lays_them_out(spark, costs, tmp_path):
    known = costs.filter("periodo IS NOT NULL")
    ranked = variance.ranked_by_month(known, known)
    plan = ran_plan(ranked)
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan
    assert "BroadcastHashJoin" in plan
    path = tmp_path / "fact"
    for _ in range(2):
        write_table(ranked, str(path), partition_by=["periodo"], cluster_by=["prestador_id"], gathered=True)
    assert same(spark.read.schema(ranked.schema).parquet(str(path)).select(*ranked.columns), windowed(known))
    assert sorted(f.parent.name for f in path.glob("*/*.parquet")) == [f"periodo=20240{m}" for m in (1, 2, 3)]


def test_the_version_travels_as_a_date(spark, costs):
    def snapshot(*providers):
        return spark.createDataFrame(
            [(p, n, "e", "r", None, None, True) for p, n in providers],
            "prestador_id string, nombre string, especialidad string, region string, cuit string, cuit_valido boolean, habilitado boolean",
        )

    days = {date(2024, 1, 1): snapshot(("P1", "a"), ("P2", "b")), date(2024, 2, 10): snapshot(("P1", "c"), ("P3", "d"))}
    history = stage(scd2.history(days), "history")
    drugs = stage(spark.createDataFrame([("M1",)], "codigo_sns string"), "catalogue")
    narrow = star.with_dimension_keys(variance.with_totals(costs, costs, history=history), history, drugs)
    assert scd2.VERSION_SINCE in narrow.columns and "prestador_sk" not in narrow.columns
    made = narrow.withColumn("prestador_sk", scd2.version_key(since=scd2.VERSION_SINCE)).select(*costs.columns, "prestador_sk")
    assert same(made, scd2.as_of_month(costs, history).select(*costs.columns, "prestador_sk"))


def test_uniqueness_of_tagged_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 2), (None, 2), (None, None), ("c", 3)], "k string, n int")
    tagged = stage(quarantine.tagged(df, [], ("k", "n")), "tagged")
    plain = quality.Uniqueness(("k", "n"))
    known = replace(plain, repeated=F.array_contains(quarantine.REASONS, quarantine.REPEATED))
    assert quality.run_suite(tagged, "d", [known]).collect() == quality.run_suite(df, "d", [plain]).collect()
    assert quality.run_suite(tagged.limit(0), "d", [known]).collect() == quality.run_suite(df.limit(0), "d", [plain]).collect()


def test_previous_of_rows_without_the_ratio(costs):
    columns = [*costs.columns, "desvio_pct_anterior", "tendencia"]
    bare = variance.with_trend(costs)
    assert "desvio_pct" not in bare.columns and "desvio_pct#" not in plan_of(bare)
    assert same(bare.select(*columns), variance.with_trend(variance.with_ratio(costs)).select(*columns))


@pytest.mark.parametrize("rows", [50, 100_000])
def test_one_shuffle_by_provider_serves_trends_totals_and_versions(spark, rows):
    data = [
        (p, m, f"M{d}" if d % 5 else None, float("nan") if d == 7 and k else 100.0 + 7 * d + 3 * k, 0.0 if d == 4 else 90.0 + 5 * k, d)
        for p, n in (("P1", 60), ("P2", 4), ("P3", 12), ("P9", 2), (None, 40))
        for k, m in enumerate(("202401", "202402", "202404", None)) for d in range(n)
    ]
    costs = stage(spark.createDataFrame(data, SCHEMA), "costs")
    days = {
        date(2024, 1, 1): [("P1", "a"), ("P2", "b"), (None, "x")], date(2024, 2, 10): [("P1", "c"), ("P2", "b"), ("P3", "d")],
        date(2024, 3, 1): [("P1", "a"), ("P3", "d"), ("P7", "e")],
    }
    schema = "prestador_id string, nombre string, especialidad string, region string, cuit string, cuit_valido boolean, habilitado boolean"
    history = stage(scd2.history({
        d: spark.createDataFrame([(p, n, "e", "r", None, None, True) for p, n in known], schema) for d, known in days.items()
    }), "history")
    gathered = variance.by_provider(costs, history, rows=rows)
    assert gathered.large.count() == (2 if rows == 50 else 0)
    got = variance.with_totals_by_provider(variance.with_trend(gathered.rows), costs, gathered.large)
    assert ran_plan(got).count("Exchange hashpartitioning") == 2  # the rows, and the versions by provider
    want = variance.with_totals(variance.with_trend(costs), costs, history=history)
    columns = [*costs.columns, "desvio_pct_anterior", "tendencia", "costo_real_acum_prestador", scd2.VERSION_SINCE]
    assert same(got.select(*columns), want.select(*columns))
    assert got.filter(f"{scd2.VERSION_SINCE} IS NOT NULL").count() > 0
    # Without a history.
    bare = variance.by_provider(costs, rows=rows)
    got = variance.with_totals_by_provider(variance.with_trend(bare.rows), costs, bare.large)
    assert same(got.select(*columns[:-1]), want.select(*columns[:-1]))


def test_the_first_load_is_as_a_load_after_nothing(spark, costs):
    known = stage(costs.filter("periodo IS NOT NULL"), "known")
    history = stage(spark.createDataFrame([("P1", date(1900, 1, 1), None)], "prestador_id string, fecha_inicio date, fecha_fin date"), "history")
    first, usual = trends.first_load(known, history), trends.trend_load(known, None, None)
    assert first.corrected is None and same(first.carry, usual.carry)
    columns = [*known.columns, "tendencia"]
    assert same(first.rows.select(*columns), usual.rows.select(*columns))
    assert "Exchange" not in plan_of(first.carry)
    scored = variance.with_ratio(known).drop("desvio_abs_ars")
    assert same(carry.last_observations(scored), usual.carry) and same(carry.merged_carry(usual.carry, known), usual.carry)


def test_trends_as_numbers(spark):
    labels = spark.createDataFrame([(t,) for t in (*V.TRENDS, None)], "t string")
    assert same(labels.select(V.trend_label(V.trend_code(F.col("t"))).alias("t")), labels)
    assert labels.select(V.trend_code(F.col("t")).alias("c")).schema["c"].dataType.simpleString() == "tinyint"


def test_factors_of_amounts_travel_instead_of_products(spark, tmp_path):
    """Costs by line, with missing prices, shares, quantities and flags, against their formula in SQL."""
    lines = [
        (p, s, n, q, x, d, f, datetime(2001, 1 + k % 2, 3))
        for k, (q, x, d, f) in enumerate(((1.0, 10.25, 0.05, "R"), (None, 3.5, 0.0, "N"), (2.0, None, 0.1, "R"), (5.0, 7.75, None, "A"), (3.0, 1.0, 0.0, None)))
        for p in (1, 2) for s in (1, None) for n in (1, 7, None)
    ]
    spark.createDataFrame(
        lines, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_returnflag string, l_shipdate timestamp_ntz",
    ).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(
        [(1, "n", "Brand#1", "t", 1, 1.0), (2, "n", "Brand#2", "t", 1, 1.0)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    ).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").createOrReplaceTempView("gathered_lines")
    want = spark.sql("""
        SELECT format_string('P%04d', l_suppkey) AS prestador_id, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS string) AS periodo,
               concat('BRAND#', l_partkey) AS codigo_sns,
               SUM(floor(l_extendedprice * 100 + 0.5) * (100 - floor(l_discount * 100 + 0.5))) / 10000 AS costo_real,
               SUM(CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 0
                   ELSE floor(l_extendedprice * 100 + 0.5) * (75 + CAST(l_quantity AS long)) END) / 10000 AS costo_ppto,
               CAST(SUM(l_quantity) AS int) AS cantidad
        FROM gathered_lines GROUP BY l_suppkey, year(l_shipdate) * 100 + month(l_shipdate), l_partkey""")
    assert same(adapters.costs(spark, str(tmp_path)), want)
