import pytest
from conftest import rows
from pyspark.sql import functions as F

from varcost import contracts as C
from varcost.functions.keys import surrogate_key
from varcost.sources import readers
from varcost.sources.demo import demo_frames


def test_missing_and_mistyped_columns_fail_before_any_job(spark):
    df = spark.range(1).select(F.lit("a").alias("prestador_id"), F.lit("1").alias("costo_real"))
    with pytest.raises(C.ContractError) as error:
        C.enforce_contract(df, C.COSTS)
    assert "periodo" in str(error.value) and "costo_real: string instead of double" in str(error.value)


def test_extra_columns_are_left_out_unless_named(spark, demo):
    df = demo[2].withColumn("seq", F.lit(1)).withColumn("other", F.lit(2))
    assert C.enforce_contract(df, C.COSTS).columns == C.COSTS.names
    assert C.enforce_contract(df, C.COSTS, ("seq",)).columns == [*C.COSTS.names, "seq"]


def test_null_violations(spark):
    df = spark.createDataFrame([(None, "202401", "M", 1.0, None, 1), (None, "202401", "M", 1.0, 2.0, None)],
                               "prestador_id string, periodo string, codigo_sns string, costo_real double, costo_ppto double, cantidad int")
    assert dict(rows(C.null_violations(df, C.COSTS))) == {
        "prestador_id": 2, "periodo": 0, "codigo_sns": 0, "costo_real": 0, "costo_ppto": 1,
    }


def test_typed_relation_rejects_nulls(spark):
    with pytest.raises(Exception, match="NULLABLE"):
        spark.createDataFrame([(None, "202401", "M", 1.0, 1.0, 1)], C.COSTS)
    assert [df.count() for df in demo_frames(spark)] == [4, 3, 6]


def test_parquet_scan(spark, demo, tmp_path):
    path = str(tmp_path / "costos")
    demo[2].write.parquet(path)
    assert sorted(rows(readers.read_parquet(spark, path, C.COSTS))) == sorted(rows(demo[2]))
    demo[2].drop("costo_ppto").write.parquet(str(tmp_path / "short"))
    with pytest.raises(C.ContractError):
        readers.read_parquet(spark, str(tmp_path / "short"), C.COSTS)


def test_filters_and_columns_reach_the_parquet_scan(spark, demo, tmp_path):
    path = str(tmp_path / "costos")
    demo[2].write.parquet(path)
    df = readers.read_parquet(spark, path, C.COSTS).filter("costo_real > 100000").select("codigo_sns")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(costo_real,100000.0)" in plan
    assert "ReadSchema: struct<codigo_sns:string,costo_real:double>" in plan


def test_csv_seed_fails_or_quarantines(spark, demo, tmp_path):
    good = str(tmp_path / "good")
    demo[2].write.option("header", True).csv(good)
    assert sorted(rows(readers.read_csv(spark, good, C.COSTS))) == sorted(rows(demo[2]))
    bad = tmp_path / "bad.csv"
    bad.write_text("prestador_id,periodo,codigo_sns,costo_real,costo_ppto,cantidad\nP1,202401,M1,1.5,2.0,3\nP2,202401,M1,abc,2.0,3\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(bad), C.COSTS).collect()
    kept, corrupt = readers.split_corrupt(readers.read_csv(spark, str(bad), C.COSTS, quarantine=True).cache())
    assert [r["prestador_id"] for r in kept.collect()] == ["P1"]
    assert [r[0] for r in corrupt.collect()] == ["P2,202401,M1,abc,2.0,3"]


def test_jdbc_scan_is_partitioned():
    # The options only: reading would need a database.
    options = readers.jdbc_options("jdbc:postgresql://host/db", "budget", "id", 1, 1000, 16)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "16"
    assert (options["lowerBound"], options["upperBound"]) == ("1", "1000")


def test_surrogate_keys_separate_their_parts(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", "b|c")], "x string, y string")
    keys = [r[0] for r in df.select(surrogate_key(F.col("x"), F.col("y"))).collect()]
    assert keys[1] == keys[2] != keys[0] and len(keys[0]) == 64


def test_conform(spark):
    df = spark.createDataFrame([("k", None)], "codigo_sns string, medicamento_sk string").withColumn("precio_ref", F.lit(2.5))
    got = C.conform_to(df, C.DIM_CATALOGUE, {"medicamento_sk": "UNKNOWN"})
    assert got.columns == C.DIM_CATALOGUE.names
    assert [f.dataType for f in got.schema] == [f.dataType for f in C.DIM_CATALOGUE]
    row = got.first()
    assert (row["medicamento_sk"], float(row["precio_ref"]), row["nombre"]) == ("UNKNOWN", 2.5, None)
    with pytest.raises(C.ContractError):
        C.conform_to(df.drop("codigo_sns"), C.DIM_CATALOGUE, {"medicamento_sk": "UNKNOWN"})
