"""What travels between tasks: rows take along only what they do not give by themselves."""

from datetime import date, datetime

import pyarrow.parquet as pq
import pytest
from conftest import plan_of, ran_plan, rows
from pyspark.sql import functions as F

from varcost.contracts import COSTS, FACT
from varcost.operators import carry, quarantine, scd2, star, variance
from varcost.sinks.scratch import stage
from varcost.sinks.writers import write_table

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
RUN = star.Run(datetime(2024, 5, 1))


@pytest.fixture(scope="module")
def costs(spark):
    data = [
        (p, m, f"M{d}", 100.0 + 7 * d + 3 * k, 0.0 if d == 4 else 90.0 + 5 * k, d)
        for p in ("P1", "P2", "P3", "P9", None) for k, m in enumerate(("202401", "202402", "202404", None)) for d in range(6)
    ]
    schema = "prestador_id string, periodo string, codigo_sns string, costo_real double, costo_ppto double, cantidad int"
    return stage(spark.createDataFrame(data, schema), "costs")


@pytest.fixture(scope="module")
def history(spark):
    def snapshot(*providers):
        return spark.createDataFrame(
            [(p, n, "e", "r", None, None, True) for p, n in providers],
            "prestador_id string, nombre string, especialidad string, region string, cuit string, cuit_valido boolean, habilitado boolean",
        )

    days = {date(2024, 1, 1): snapshot(("P1", "a"), ("P2", "b")), date(2024, 2, 10): snapshot(("P1", "c"), ("P2", "b"), ("P3", "d"))}
    return stage(scd2.history(days), "history")


@pytest.fixture(scope="module")
def catalogue(spark):
    return stage(spark.createDataFrame([(f"M{d}",) for d in range(5)], "codigo_sns string"), "catalogue")


@pytest.fixture
def no_broadcast(spark):
    for key, value in NO_BROADCAST.items():
        spark.conf.set(key, value)
    yield
    for key in NO_BROADCAST:
        spark.conf.unset(key)


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_versions_are_looked_up_once_per_provider_and_month(spark, costs, history, catalogue, no_broadcast):
    by_row = star.star_fact(variance.budget_variance(costs), history, catalogue, RUN)
    by_total = star.star_fact(variance.budget_variance(costs, history=history), history, catalogue, RUN)
    assert same(by_total, by_row)
    assert by_total.filter("prestador_sk = 'UNKNOWN'").count() < by_total.count()


def test_derived_columns_do_not_travel(costs, no_broadcast):
    """Only costs reach the window over series: no ratio, difference, alert or band is shuffled or sorted with them."""
    whole = variance.budget_variance(costs)
    assert whole.columns == [*costs.columns, *variance.VARIANCE_COLUMNS]
    plan = ran_plan(whole)
    tops = [k for k, line in enumerate(plan.splitlines()) if "Join" in line or "Exchange" in line]
    below = "\n".join(plan.splitlines()[tops[0]:])
    assert "AS severidad" not in below and "AS desvio_abs_ars" not in below and "AS desvio_pct#" not in below


def test_finished_rows_are_written_as_whole_ones(spark, costs, history, catalogue, tmp_path):
    narrow = star.with_dimension_keys(variance.narrow_variance(costs, history=history), history, catalogue).filter("periodo IS NOT NULL")
    travelling = variance.with_bands(variance.with_ratio(narrow)).drop("desvio_pct", "desvio_abs_ars")
    path = str(tmp_path / "fact")
    for _ in range(2):
        write_table(
            travelling, path, partition_by=["periodo"], cluster_by=["prestador_id", "severidad"],
            finish=lambda df: star.as_fact(variance.with_ratio(df), RUN),
        )
    want = star.star_fact(variance.budget_variance(costs), history, catalogue, RUN).filter("periodo IS NOT NULL")
    got = spark.read.schema(FACT).parquet(path)
    assert same(got.select(*FACT.names), want)
    for file in (tmp_path / "fact").glob("periodo=*/*.parquet"):
        written = pq.read_table(file).to_pylist()
        keys = [((r["prestador_id"] is not None, r["prestador_id"] or ""), r["severidad"]) for r in written]
        assert keys == sorted(keys)
        assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"


def test_rows_are_not_shuffled_to_meet_few_repeats(spark, costs):
    rules = quarantine.required(COSTS)
    grain = ["prestador_id", "codigo_sns", "periodo"]
    tagged = quarantine.tagged(costs.unionByName(costs.limit(2)), rules, grain)
    assert "BroadcastHashJoin" in plan_of(tagged)
    assert tagged.filter(F.array_contains("motivos", "grain")).count() == 4


def test_the_last_observation_of_a_series(spark):
    df = spark.createDataFrame(
        [("P", "M", "202401", 9.0, 1.0, 8.0), ("P", "M", "202402", 1.0, 1.0, 0.0), ("P", "M", "202402", 2.0, 1.0, None),
         ("P", "M", None, 5.0, 1.0, 4.0), ("Q", "M", None, 5.0, 1.0, 4.0)],
        "prestador_id string, codigo_sns string, periodo string, costo_real double, costo_ppto double, desvio_pct double",
    )
    assert rows(carry.last_observations(df), "prestador_id") == [
        ("P", "M", "202402", 2.0, 1.0, None), ("Q", "M", None, 5.0, 1.0, 4.0),
    ]
