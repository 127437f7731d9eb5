from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from varcost import contracts as C
from varcost.sinks import ddl, scratch, writers
from varcost.sources.calendar import calendar
from varcost.sinks.versions import read_latest, write_version


def sample(spark, months=("202401", "202402"), value=1.0):
    return spark.createDataFrame([(m, f"P{i}", value) for m in months for i in range(3)], "periodo string, p string, v double")


def test_overwrite_replaces_only_the_months_written(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_table(sample(spark), path, partition_by=["periodo"], cluster_by=["p"])
    writers.write_table(sample(spark, ("202402",), 2.0), path, partition_by=["periodo"], cluster_by=["p"])
    writers.write_table(sample(spark, ("202402",), 2.0), path, partition_by=["periodo"], cluster_by=["p"])
    got = spark.read.schema("p string, v double, periodo string").parquet(path)
    assert rows(got.groupBy("periodo").agg(F.count("*"), F.sum("v")), "periodo") == [("202401", 3, 3.0), ("202402", 3, 6.0)]
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"periodo=202401", "periodo=202402"}


def test_append_and_error_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    for mode in ("append", "append"):
        writers.write_table(sample(spark), path, mode=mode)
    assert spark.read.parquet(path).count() == 12
    with pytest.raises(Exception):
        writers.write_table(sample(spark), path, mode="errorifexists")


def test_rows_are_sorted_on_the_cluster_columns(spark, tmp_path):
    df = spark.range(1000).selectExpr("cast(id % 2 AS string) AS periodo", "cast(rand(1) * 1e6 AS int) AS p")
    path = str(tmp_path / "t")
    writers.write_table(df, path, partition_by=["periodo"], cluster_by=["p"])
    for file in (tmp_path / "t").rglob("*.parquet"):
        values = [r["p"] for r in spark.read.parquet(str(file)).collect()]
        assert values == sorted(values)


def test_fallback_only_for_a_missing_format(spark, tmp_path):
    path = str(tmp_path / "fallback")
    written = writers.write_table(sample(spark), "ds.t", fmt="bigquery", mode="append", partition_by=["periodo"], fallback=path)
    assert (written.fmt, written.target) == ("parquet", path)
    assert written.read(spark).count() == 6
    with pytest.raises(Exception, match="DATA_SOURCE_NOT_FOUND"):
        writers.write_table(sample(spark), "ds.t", fmt="bigquery")
    failing = sample(spark).withColumn("v", F.raise_error(F.lit("broken row")).cast("double"))
    with pytest.raises(Exception, match="broken row"):
        writers.write_table(failing, str(tmp_path / "x"), fmt="json", fallback=path)


def test_a_rerun_in_another_file_format_keeps_the_other_months(spark, tmp_path):
    path = str(tmp_path / "orc")
    writers.write_table(sample(spark), path, fmt="orc", partition_by=["periodo"])
    before = spark.read.orc(path).count()
    written = writers.write_table(sample(spark, ("202402",), 2.0), path, fmt="orc", partition_by=["periodo"])
    assert written.read(spark).count() == before


def test_a_connector_must_not_replace_a_whole_table_unasked(spark):
    with pytest.raises(ValueError, match="replace the whole table"):
        writers.write_table(sample(spark), "ds.t", fmt="bigquery", partition_by=["periodo"])


def test_versions(spark, tmp_path):
    path = str(tmp_path / "dim")
    assert read_latest(spark, path) is None
    write_version(sample(spark, value=1.0), path, "20240101T000000", ["p"])
    # A table computed from its own previous version.
    write_version(read_latest(spark, path).withColumn("v", F.lit(5.0)), path, "20240201T000000", ["p"])
    assert {r["v"] for r in read_latest(spark, path).collect()} == {5.0}
    assert read_latest(spark, path).columns == ["periodo", "p", "v"]
    # Another attempt of the same run, computed from the first, replaces nothing.
    second = write_version(read_latest(spark, path).withColumn("v", F.col("v") + 1), path, "20240201T000000")
    assert second == "20240201T000000-0001"
    assert {r["v"] for r in read_latest(spark, path).collect()} == {6.0}
    assert len(list((tmp_path / "dim").glob("version=*"))) == 3


def test_warehouse_tables(spark):
    ddl.create_warehouse(spark, "dw_test")
    ddl.create_warehouse(spark, "dw_test")
    assert {t.name for t in spark.catalog.listTables("dw_test")} == set(C.WAREHOUSE)
    described = {r["col_name"]: r for r in spark.sql("DESCRIBE dw_test.dim_tiempo").collect()}
    assert described["es_periodo_cierre"]["comment"] == "Quarterly budget close"
    extended = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED dw_test.fact_costos_prestacionales").collect()}
    assert "sensitivity=high" in extended["Table Properties"]
    assert "required=fact_id" in extended["Table Properties"]
    spark.sql("INSERT INTO dw_test.dim_prestador (prestador_sk, prestador_id) VALUES ('k', 'P1')")
    assert spark.table("dw_test.dim_prestador").first()["es_vigente"] is True


def test_insert_is_idempotent(spark):
    ddl.create_warehouse(spark, "dw_test")
    months = calendar(spark, date(2020, 1, 1), date(2026, 12, 1))
    for _ in range(2):
        ddl.insert_table(months, "dw_test", C.WAREHOUSE["dim_tiempo"])
    assert spark.table("dw_test.dim_tiempo").count() == 84
    fact = spark.createDataFrame([("202401", "P1"), ("202402", "P1")], "periodo string, prestador_id string")
    spec = C.WAREHOUSE["fact_costos_prestacionales"]
    defaults = {f.name: "0" for f in C.FACT if not f.nullable}
    rows_ = C.conform_to(fact, C.FACT, defaults)
    ddl.insert_table(rows_, "dw_test", spec)
    ddl.insert_table(rows_.filter("periodo = '202402'"), "dw_test", spec)
    assert rows(spark.table("dw_test.fact_costos_prestacionales").groupBy("periodo").count(), "periodo") == [
        ("202401", 1), ("202402", 1),
    ]


def test_calendar(spark):
    months = calendar(spark, date(2020, 1, 1), date(2026, 12, 1))
    assert months.count() == 84
    by_id = {r["periodo_id"]: r for r in months.collect()}
    june = by_id["202406"]
    assert (june["anio"], june["mes"], june["trimestre"], june["semestre"], june["nombre_mes"]) == (2024, 6, 2, 1, "June")
    assert (june["es_fin_de_anio"], june["es_periodo_alta"], june["es_periodo_cierre"]) == (False, True, True)
    assert by_id["202412"]["es_fin_de_anio"] and by_id["202407"]["semestre"] == 2
    assert months.schema.names == C.DIM_MONTH.names
    assert [f.dataType for f in months.schema] == [f.dataType for f in C.DIM_MONTH]


def test_scratch_comes_from_the_session(spark):
    assert scratch.scratch_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = scratch.stage(sample(spark), "t")
    assert staged.count() == 6
