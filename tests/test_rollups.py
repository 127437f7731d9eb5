"""Clustering, distinct roll-ups, as-of merge and reconciliation."""

import random
from datetime import date, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from varcost.operators import asof, reconcile, rollup, scd2
from varcost.sinks import clustering

from conftest import rows


# Clustering --------------------------------------------------------------------------------


def groups_read(path, column, value):
    """Row groups whose range holds a value, and all of them."""
    hit = total = 0
    for file in path.glob("*.parquet"):
        footer = pq.ParquetFile(file).metadata
        at = footer.schema.to_arrow_schema().names.index(column)
        for k in range(footer.num_row_groups):
            stats = footer.row_group(k).column(at).statistics
            total += 1
            hit += stats.min <= value <= stats.max
    return hit, total


def test_filters_on_any_clustered_column_skip_files(spark, tmp_path):
    df = spark.range(20_000).select(
        F.concat(F.lit("p"), F.format_string("%04d", F.pmod(F.xxhash64("id"), F.lit(500)))).alias("p"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(300)).alias("n"), F.rand(3).alias("x"),
    )
    df.write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    columns = ["p", "n", "x"]
    clustering.clustered(df, columns, files=64).write.parquet(f"{tmp_path}/curve")
    df.repartitionByRange(64, *columns).sortWithinPartitions(*columns).write.parquet(f"{tmp_path}/sorted")
    assert sorted(rows(spark.read.parquet(f"{tmp_path}/curve"))) == sorted(rows(df))
    for column, value in (("p", "p0250"), ("n", 150), ("x", 0.5)):
        hit, total = groups_read(tmp_path / "curve", column, value)
        assert total >= 60 and hit <= 0.4 * total, column
    # The lexicographic sort helps its first column only.
    assert groups_read(tmp_path / "sorted", "x", 0.5)[0] >= 60


def test_ranks_nulls_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else k % 3, k % 2 == 0, None) for k in range(50)], "i int, t int, b boolean, s string")
    got = clustering.clustered(df, ["t", "b", "s"])
    assert sorted(rows(got), key=str) == sorted(rows(df), key=str)
    assert clustering.clustered(df.limit(0), ["t", "s"]).count() == 0
    bounds = [2, 5, 5, 9]
    ranks = spark.createDataFrame([(v,) for v in (None, 1, 2, 4, 5, 9, 10)], "v int").select(clustering.rank_in(F.col("v"), bounds).alias("r"))
    assert [r[0] for r in ranks.collect()] == [0, 0, 1, 1, 3, 4, 4]
    key = spark.range(1).select(clustering.curve_key([F.lit(0b11), F.lit(0b01)], 2)).first()[0]
    assert key == 0b1011
    with pytest.raises(ValueError):
        clustering.clustered(df, ["i"] * 8)


# Roll-up -----------------------------------------------------------------------------------


def test_quarters_and_years_from_monthly_bitmaps(spark):
    rng = random.Random(1)
    data = [(f"{y}{m:02d}", None if k % 17 == 0 else f"p{rng.randint(0, 70_000)}") for y in (2023, 2024) for m in range(1, 13) for k in range(200)]
    data += [("190001", "p1")]
    fact = spark.createDataFrame(data, "periodo_id string, prestador_id string")
    ids = rollup.dense_ids(fact, "prestador_id").cache()
    n = ids.count()
    assert sorted(r["id"] for r in ids.collect()) == list(range(n)) and ids.select("prestador_id").distinct().count() == n
    months = spark.createDataFrame([(f"{y}{m:02d}", y, (m + 2) // 3) for y in (2023, 2024) for m in range(1, 13)], "periodo_id string, anio long, trimestre long")
    # Ids far apart fall into several buckets.
    ids = ids.withColumn("id", F.col("id") * 50)
    states = rollup.distinct_states(fact, ["periodo_id"], "prestador_id", ids)
    got = {(r["nivel"], r["periodo"]): r["prestadores"] for r in rollup.period_rollup(states, months).collect()}
    want = {}
    for period, who in data:
        if who:
            want.setdefault(("mes", period), set()).add(who)
            if period != "190001":
                want.setdefault(("trimestre", f"{period[:4]}T{(int(period[4:]) + 2) // 3}"), set()).add(who)
                want.setdefault(("anio", period[:4]), set()).add(who)
    assert got == {k: len(v) for k, v in want.items()}
    assert rollup.dense_ids(fact.limit(0), "prestador_id").count() == 0


# As-of merge -------------------------------------------------------------------------------


def versions_of(spark, data):
    schema = "prestador_id string, fecha_inicio date, fecha_fin date, prestador_sk string"
    return spark.createDataFrame([(p, a, b, f"{p}-{a}") for p, a, b in data], schema)


@pytest.mark.parametrize("salt", [1, 5])
def test_ten_thousand_versions_of_one_provider(spark, salt):
    first = date(1990, 1, 1)
    cuts = [first + timedelta(days=k) for k in range(10_001)]
    data = [("hot", a, b) for a, b in zip(cuts, cuts[1:])]
    data += [("gap", date(2000, 1, 10), date(2000, 3, 5)), ("gap", date(2005, 6, 1), None), (None, date(2000, 1, 1), None)]
    dimension = versions_of(spark, data)
    fact = spark.createDataFrame(
        [(p, f"{y}{m:02d}", k) for p in ("hot", "gap", "none", None) for y in (1985, 1990, 2000, 2005, 2016, 2018) for m in (1, 2, 3, 6, 12) for k in (1, 1)]
        + [("hot", None, 3)],
        "prestador_id string, periodo string, n int",
    )
    got = asof.as_of_month_merge(fact, dimension, salt=salt)
    want = scd2.as_of_month(fact, dimension)
    assert got.columns == want.columns and sorted(rows(got), key=str) == sorted(rows(want), key=str)


# Reconciliation ----------------------------------------------------------------------------


def test_every_state_of_a_key(spark):
    schema = "prestador_id string, codigo_sns string, periodo string, costo_ppto double"
    seed = [("a", "c", "1", 5.0), ("b", "c", "1", 5.0), ("c", "c", "1", 1.0), ("c", "c", "1", 1.0), (None, "c", "1", 2.0), ("d", "c", "1", None), ("e", "c", "1", None), ("g", "c", "1", 1.0)]
    real = [("a", "c", "1", 5.0), ("b", "c", "1", 7.0), ("c", "c", "1", 2.0), (None, "c", "1", 2.0), ("d", "c", "1", None), ("e", "c", "1", 3.0), ("f", "c", "1", 1.0)]
    found = reconcile.budget_reconcile(spark.createDataFrame(seed, schema), spark.createDataFrame(real, schema))
    got = {r["prestador_id"]: (r["estado"], r["filas_presupuesto"], r["filas_real"], r["diferencia"]) for r in found.collect()}
    assert got == {
        "a": ("IGUAL", 1, 1, 0.0), "b": ("DIFERENTE", 1, 1, 2.0), "c": ("REPETIDO", 2, 1, 0.0), None: ("IGUAL", 1, 1, 0.0),
        "d": ("IGUAL", 1, 1, None), "e": ("DIFERENTE", 1, 1, None), "f": ("SOLO_REAL", 0, 1, None), "g": ("SOLO_PRESUPUESTO", 1, 0, None),
    }
    assert {r["estado"]: r["claves"] for r in reconcile.reconcile_summary(found).collect()}["IGUAL"] == 3
    near = reconcile.budget_reconcile(spark.createDataFrame(seed, schema), spark.createDataFrame(real, schema), tolerance=2.0)
    assert {r["prestador_id"]: r["estado"] for r in near.collect()}["b"] == "IGUAL"
