import math
from datetime import date

import pytest
from conftest import plan_of, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from varcost.operators import ranking, variance
from varcost.plans import audit, marts
from varcost.sources.calendar import calendar

COSTS = "prestador_id string, periodo string, codigo_sns string, costo_real double, costo_ppto double, cantidad int"


@pytest.fixture(scope="module")
def full(demo):
    return variance.budget_variance(demo[2]).cache()


def test_demo_rows(full):
    got = rows(
        full.select(
            "prestador_id", "periodo", "codigo_sns", F.round("desvio_pct", 6), "desvio_abs_ars",
            "alerta_flag", "severidad", "rank_desvio_periodo", F.round("desvio_pct_anterior", 6),
            "tendencia", "costo_real_acum_prestador",
        ),
        "periodo", "rank_desvio_periodo",
    )
    assert got == [
        ("H1", "202403", "N10", 0.3, 12000.0, True, "CRITICO", 1, None, "NUEVO", 77500.0),
        ("H2", "202403", "N30", 0.22, 11000.0, True, "ALTO", 2, None, "NUEVO", 137000.0),
        ("H2", "202403", "N20", -0.05, -4000.0, False, "MODERADO", 3, None, "NUEVO", 137000.0),
        ("H1", "202403", "N30", 0.02, 500.0, False, "NORMAL", 4, None, "NUEVO", 77500.0),
        ("H1", "202404", "N10", 0.15, 6000.0, True, "ALTO", 1, 0.3, "MEJORA", 46000.0),
        ("H2", "202404", "N20", 0.125, 10000.0, False, "MODERADO", 2, -0.05, "EMPEORA", 90000.0),
    ]


def test_summaries(spark, full, demo):
    fact = full.withColumn("periodo_id", F.col("periodo"))
    months = calendar(spark, date(2020, 1, 1), date(2026, 12, 1))
    assert rows(marts.period_summary(fact, months), "periodo_id") == [
        ("202403", "March", 2024, 1, 2, 4, 214500.0, 195000.0, 19500.0, 0.1, 2, 1, 0),
        ("202404", "April", 2024, 2, 2, 2, 136000.0, 120000.0, 16000.0, 16 / 120, 1, 0, 1),
    ]
    history = demo[1].withColumn("es_vigente", F.lit(True))
    top = marts.top_providers(fact, history).select(
        "periodo_id", "prestador_id", F.round("desvio_pct_prestador", 6), "rank_periodo"
    )
    assert rows(top, "periodo_id", "rank_periodo") == [
        ("202403", "H1", 0.192308, 1), ("202403", "H2", 0.053846, 2), ("202404", "H1", 0.15, 1), ("202404", "H2", 0.125, 2),
    ]
    marts.create_views(fact, months, history)
    assert spark.sql("SELECT sum(total_alertas) FROM v_resumen_desvios_periodo").first()[0] == 3
    assert spark.table("v_top_prestadores_desvio").count() == 4


def test_severity_profile_and_alert_checks(spark, full):
    profile = audit.severity_profile(full).select(
        "severidad", "cantidad", F.round("desvio_min", 6), "desvio_max", F.round("desvio_avg", 6)
    )
    # Rows keep the order of the report: highest average first.
    assert rows(profile)[:2] == [("CRITICO", 1, 0.3, 0.3, 0.3), ("ALTO", 2, 0.15, 0.22, 0.185)]
    assert audit.alerts_without_variance(full).first()["inconsistencias"] == 0
    planted = spark.createDataFrame([(None, True), (0.2, True), (None, None)], "desvio_pct double, alerta_flag boolean")
    assert rows(audit.alerts_without_variance(planted)) == [("alertas_sin_desvio", 1)]


def test_orphans_are_counted_per_row(full, demo):
    only_h1 = demo[1].filter("prestador_id = 'H1'")
    assert rows(audit.orphan_facts(full, only_h1)) == [("integridad_prestador", 3)]
    assert rows(audit.orphan_facts(full, demo[1])) == [("integridad_prestador", 0)]


@pytest.mark.parametrize(
    ("actual", "budget", "pct", "alert", "band"),
    [
        (110.0, 0.0, None, None, "NORMAL"),
        (110.0, -5.0, None, None, "NORMAL"),
        (110.0, None, None, None, "NORMAL"),
        (None, 100.0, None, None, "NORMAL"),
        (1.15, 1.0, 1.15 - 1.0, False, "MODERADO"),  # just below the bound in binary
        (115.0, 100.0, 0.15, True, "ALTO"),
        (105.0, 100.0, 0.05, False, "MODERADO"),
        (130.0, 100.0, 0.30, True, "CRITICO"),
        (70.0, 100.0, -0.30, True, "CRITICO"),
        (104.0, 100.0, 0.04, False, "NORMAL"),
    ],
)
def test_bounds(spark, actual, budget, pct, alert, band):
    df = spark.createDataFrame([("P", "202401", "M", actual, budget, 1)], COSTS)
    row = variance.with_bands(variance.with_ratio(df)).first()
    assert (row["desvio_pct"], row["alerta_flag"], row["severidad"]) == (pct, alert, band)


def test_trend_skips_missing_months_and_missing_values(spark):
    def cost(month, actual, budget=100.0):
        return ("P", month, "M", actual, budget, 1)

    df = spark.createDataFrame(
        [cost("202401", 110.0), cost("202404", 105.0), cost("202405", 105.0), cost("202406", 120.0),
         cost("202407", 120.0, 0.0), cost("202408", 120.0)],
        COSTS,
    )
    got = rows(variance.with_trend(variance.with_ratio(df)).select("periodo", "tendencia"), "periodo")
    assert [t for _, t in got] == ["NUEVO", "MEJORA", "ESTABLE", "EMPEORA", "ESTABLE", "NUEVO"]


def test_custom_names_and_bands(spark):
    spec = variance.VarianceSpec(
        provider="shop", item="sku", month="m", actual="spent", budget="planned",
        alert_at=0.5, bands=(("HIGH", 0.5), ("LOW", 0.1)),
    )
    df = spark.createDataFrame([("a", "x", "202401", 160.0, 100.0)], "shop string, sku string, m string, spent double, planned double")
    row = variance.budget_variance(df, spec).first()
    assert (row["severidad"], row["alerta_flag"], row["rank_desvio_periodo"]) == ("HIGH", True, 1)


def test_money_sums_keep_values_a_decimal_cannot_hold(spark):
    from varcost.functions.variance import money_sum

    nan, inf = float("nan"), float("inf")
    data = [("exact", 0.1), ("exact", 0.2), ("exact", None), ("nan", nan), ("nan", 1.0), ("inf", inf), ("inf", 1.0),
            ("both", inf), ("both", -inf), ("none", None)]
    df = spark.createDataFrame(data, "k string, x double").repartition(3)
    got = {k: v for k, v in rows(df.groupBy("k").agg(money_sum(F.col("x"))))}
    assert (got["exact"], got["inf"], got["none"]) == (0.3, inf, None)
    assert math.isnan(got["nan"]) and math.isnan(got["both"])


def test_money_sums_keep_small_and_large_amounts(spark):
    from varcost.functions.variance import money_sum

    for data, want in ((10 * [(0.00003,)], 0.0003), ([(1e15,), (1e15,)], 2e15)):
        assert spark.createDataFrame(data, "x double").agg(money_sum(F.col("x"))).first()[0] == want
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        spark.createDataFrame([(1e21,)], "x double").agg(money_sum(F.col("x"))).collect()


def _reference_rank(df):
    w = Window.partitionBy("g").orderBy(F.col("x").desc_nulls_last())
    return df.withColumn("r", F.rank().over(w).cast("long"))


HARD = [
    None, None, None, 0.0, -0.0, 0.0, 5e-324, 1e-300, 1e-12, 2e-12, 0.1, 0.1, 0.1 + 1e-17, math.nextafter(0.1, 1),
    math.nextafter(0.1, 0), 1 / 1024, math.nextafter(1 / 1024, 0), 0.3, 1.0, math.nextafter(1.0, 0), 63.999999,
    64.0, 64.2, 64.1, 65.0, 65535.5, 65536.0, 65537.25, 1e9, 1e18, 1e19, 1e300, 1e306, float("inf"), float("inf"),
    float("nan"), float("nan"),
]


@pytest.mark.parametrize("bits", [(10, 16), (4,), (10, 16, 16), (1, 2)])
def test_rank_equals_window_rank(spark, bits):
    import random

    rng = random.Random(7)
    values = HARD + [rng.random() for _ in range(300)] + [rng.expovariate(0.01) for _ in range(100)]
    data = [(g, i, x) for g in ("a", "b", None) for i, x in enumerate(values[: 437 if g else 40])]
    df = spark.createDataFrame(data, "g string, i int, x double")
    ranks = ranking.magnitude_ranks(df, "g", F.col("x"), "r", bits)
    got = ranking.join_ranks(df, ranks, "g", F.col("x"))
    assert rows(got.select("g", "i", "r"), "g", "i") == rows(_reference_rank(df).select("g", "i", "r"), "g", "i")


def test_rank_of_one_hot_value_and_of_close_values(spark):
    # Two thirds of the rows share one value, and many distinct ones lie in one cell.
    hot = spark.range(6000).select(
        F.lit("m").alias("g"), "id",
        F.when(F.col("id") % 3 < 2, 0.25).otherwise(0.1 + F.col("id") * 1e-14).alias("x"),
    )
    got = ranking.join_ranks(hot, ranking.magnitude_ranks(hot, "g", F.col("x"), "r"), "g", F.col("x"))
    want = _reference_rank(hot)
    assert got.select("id", "r").exceptAll(want.select("id", "r")).count() == 0
    assert got.count() == 6000


def test_cells_are_fine_at_every_magnitude(spark):
    n = 200_000
    for low, step in ((70_000.0, 1.0), (64.0, 0.8 / n), (1e-9, 1e-14), (1e12, 1e7)):
        df = spark.range(n).select((F.lit(low) + F.col("id") * step).alias("x"))
        cells = ranking._digits(df, "x", ranking.DIGIT_BITS).groupBy("_digit0", "_digit1", "_digit2").count()
        cell_count, largest = cells.agg(F.count("*"), F.max("count")).first()
        assert cell_count > n / 20 and largest <= 40, (low, cell_count, largest)


def test_octaves_are_exact_next_to_powers_of_two(spark):
    values = [math.nextafter(2.0**e, to) for e in range(-1074, 1024, 3) for to in (0, 2.0**e, math.inf)]
    df = spark.createDataFrame([(x,) for x in values if x > 0], "x double")
    for x, octave in rows(ranking._digits(df, "x", (10,)).select("x", "_digit0")):
        assert octave == math.frexp(x)[1] - 1, x


def test_no_window_holds_a_whole_month_or_provider(demo, full):
    plan = plan_of(variance.budget_variance(demo[2]))
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    for line in windows:
        keys = line.split("windowspecdefinition(")[1]
        assert not keys.startswith("prestador_id#") or "codigo_sns#" in keys.split("ASC")[0]
    assert "rank(" not in plan.replace("rank_desvio_periodo", "")


def test_top_report_limits_groups_before_the_shuffle(demo, full):
    fact = full.withColumn("periodo_id", F.col("periodo"))
    history = demo[1].withColumn("es_vigente", F.lit(True))
    plan = plan_of(marts.top_providers(fact, history))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_top_report_breaks_ties_by_provider_and_keeps_twenty(spark):
    data = [(f"P{i:03d}", "202401", "M", 120.0, 100.0, 1) for i in range(25)]
    fact = variance.with_trend(variance.with_bands(variance.with_ratio(spark.createDataFrame(data, COSTS))))
    fact = fact.withColumn("periodo_id", F.col("periodo"))
    none = spark.createDataFrame([], "prestador_id string, nombre string, region string, especialidad string, es_vigente boolean")
    top = marts.top_providers(fact, none)
    assert [r["prestador_id"] for r in top.orderBy("rank_periodo").collect()] == [f"P{i:03d}" for i in range(20)]


def test_predominant_trend_is_the_alphabetical_maximum(spark):
    data = [("P", "202401", "A", 110.0, 100.0, 1), ("P", "202402", "A", 120.0, 100.0, 1), ("P", "202402", "B", 1.0, 1.0, 1)]
    fact = variance.with_trend(variance.with_bands(variance.with_ratio(spark.createDataFrame(data, COSTS))))
    none = spark.createDataFrame([], "prestador_id string, nombre string, region string, especialidad string, es_vigente boolean")
    top = marts.top_providers(fact.withColumn("periodo_id", F.col("periodo")), none)
    assert {r["tendencia_predominante"] for r in top.filter("periodo_id = '202402'").collect()} == {"NUEVO"}


def test_active_alerts(full):
    assert variance.active_alerts(full).count() == 3
