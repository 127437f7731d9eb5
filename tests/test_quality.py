import pytest
from conftest import ran_plan, rows

from varcost.operators import cleaning
from varcost.operators import quality as Q
from varcost.sinks.writers import append_audit, write_report_json


def test_demo_suites(demo):
    report = Q.run_suite(cleaning.clean_catalogue(demo[0]), "nomenclador", Q.CATALOGUE_SUITE).unionByName(
        Q.run_suite(cleaning.clean_providers(demo[1]), "prestadores", Q.PROVIDER_SUITE)
    )
    assert report.columns == list(Q.REPORT_COLUMNS)
    assert {r["status"] for r in report.collect()} == {"PASS"}
    assert rows(Q.summarise(report), "df") == [("nomenclador", 4, 0, 0, "PASS"), ("prestadores", 3, 0, 0, "PASS")]
    assert len(Q.gate(Q.summarise(report))) == 2


def test_raw_catalogue_warns_but_passes(demo):
    report = Q.run_suite(demo[0], "raw", Q.CATALOGUE_SUITE)
    found = {r["check"]: (r["value"], r["status"]) for r in report.collect()}
    assert found["uniqueness:codigo_sns"] == (0.75, "WARN")
    assert rows(Q.summarise(report)) == [("raw", 4, 0, 1, "PASS")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "c string, x double")
    report = Q.run_suite(df, "empty", [Q.NullRate("c"), Q.Uniqueness(("c",)), Q.InRange("x", 0.0, 1.0)])
    assert [(r["value"], r["status"]) for r in report.collect()] == [(0.0, "PASS"), (0.0, "WARN"), (0.0, "PASS")]


def test_null_is_one_distinct_value_and_not_out_of_range(spark):
    df = spark.createDataFrame([(None, None), (None, 5.0), ("a", -1.0), ("b", float("nan"))], "c string, x double")
    report = Q.run_suite(df, "d", [Q.Uniqueness(("c",)), Q.InRange("x", 0.0, 10.0), Q.NullRate("c")])
    assert [r["value"] for r in report.collect()] == [0.75, 2.0, 0.5]


def test_status_uses_the_unrounded_rate(spark):
    df = spark.range(100_000).selectExpr("if(id < 2001, null, id) AS c")
    row = Q.run_suite(df, "d", [Q.NullRate("c")]).first()
    assert (row["value"], row["status"]) == (0.02, "FAIL")
    df = spark.range(50).selectExpr("if(id < 1, null, id) AS c")
    assert Q.run_suite(df, "d", [Q.NullRate("c")]).first()["status"] == "PASS"


def test_a_suite_scans_once(spark, demo, tmp_path):
    path = str(tmp_path / "t")
    demo[0].write.parquet(path)
    plan = ran_plan(Q.run_suite(spark.read.parquet(path), "d", Q.CATALOGUE_SUITE))
    assert plan.count("FileScan") == 1


def test_gate_and_report_file(spark, tmp_path):
    df = spark.createDataFrame([(None,), ("a",)], "c string")
    report = Q.run_suite(df, "bad", [Q.NullRate("c")])
    path = str(tmp_path / "report")
    write_report_json(Q.summaries_with_checks(report, "2024-01-01T00:00:00"), path)
    with pytest.raises(Q.DataQualityError, match="bad"):
        Q.gate_from_report(spark, path)
    ok = Q.run_suite(df, "good", [Q.NullRate("c", limit=0.6)])
    write_report_json(Q.summaries_with_checks(ok, "2024-01-01T00:00:00"), path)
    (summary,) = Q.gate_from_report(spark, path)
    assert summary["overall"] == "PASS" and summary["checks"][0]["check"] == "null_rate:c"


def test_audit_table_keeps_one_copy_per_run(spark, tmp_path):
    report = Q.run_suite(spark.range(3).selectExpr("id AS c"), "d", [Q.NullRate("c"), Q.Uniqueness(("c",))])
    path = str(tmp_path / "audit")
    for run_id in ("r1", "r2", "r2"):
        append_audit(report, path, run_id)
    assert rows(spark.read.parquet(path).groupBy("run_id").count(), "run_id") == [("r1", 2), ("r2", 2)]


def test_grain(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x")], "p string, m string")
    assert rows(Q.grain_violations(df, ["p", "m"])) == [("a", "x", 2)]
