import json
from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from varcost import contracts as C
from varcost.operators.quality import DataQualityError, gate_from_report
from varcost.operators.star import Run
from varcost.plans.monthly import landing_frames, run_monthly
from varcost.sources.demo import demo_frames
from varcost.sinks.versions import read_latest

FIRST, SECOND = Run(datetime(2024, 3, 1, 6)), Run(datetime(2024, 4, 1, 6))


def tables(spark, base):
    fact = spark.read.schema(C.FACT).parquet(f"{base}/fact_costos_prestacionales")
    return fact, read_latest(spark, f"{base}/dim_prestador"), read_latest(spark, f"{base}/dim_medicamento")


@pytest.fixture(scope="module")
def demo_run(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("dw"))
    return base, run_monthly(spark, output=base, run=FIRST, dq_report_path=f"{base}/dq")


def test_result(spark, demo_run):
    base, result = demo_run
    assert (result["run_id"], result["status"], result["records_fact"]) == ("20240301T060000", "SUCCESS", 6)
    assert {d: r["overall"] for d, r in result["dq"].items()} == {"nomenclador": "PASS", "prestadores": "PASS", "costos": "PASS"}
    assert result["smoke"] == {"integridad_prestador": 0, "alertas_sin_desvio": 0}
    assert len(gate_from_report(spark, f"{base}/dq")) == 3
    assert spark.read.parquet(f"{base}/dim_tiempo").count() == 84
    assert spark.read.parquet(f"{base}/dq_audit").filter("run_id = '20240301T060000'").count() == 10


def test_star(spark, demo_run):
    base, _ = demo_run
    fact, providers, catalogue = tables(spark, base)
    assert providers.count() == 3  # disabled providers stay in the history
    assert providers.columns == C.DIM_PROVIDER.names and catalogue.columns == C.DIM_CATALOGUE.names
    joined = fact.join(providers, "prestador_sk").join(catalogue, "medicamento_sk")
    assert joined.count() == 6
    assert fact.select("fact_id").distinct().count() == 6
    assert rows(fact.select("run_id", "_pipeline_version").distinct()) == [("20240301T060000", "1.0.0")]
    assert fact.filter("_calc_ts IS NULL").count() == 0


def test_run_timestamp_is_an_instant(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/Argentina/Buenos_Aires"):
            spark.conf.set("spark.sql.session.timeZone", name)
            seconds = spark.range(1).select(FIRST.timestamp.cast("long")).first()[0]
            assert seconds == 1709272800
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rerun_leaves_the_same_tables(spark, tmp_path):
    base = str(tmp_path)
    run_monthly(spark, output=base, run=FIRST)
    before = [rows(t.drop("run_id", "_calc_ts", "_ingestion_ts")) for t in tables(spark, base)]
    run_monthly(spark, output=base, run=FIRST)
    run_monthly(spark, output=base, run=SECOND)
    after = [rows(t.drop("run_id", "_calc_ts", "_ingestion_ts")) for t in tables(spark, base)]
    assert [sorted(map(repr, t)) for t in before] == [sorted(map(repr, t)) for t in after]


def landing(spark, base, catalogue=None, providers=None, costs=None):
    demo = demo_frames(spark)
    for name, given, default in zip(("nomenclador", "prestadores", "costos"), (catalogue, providers, costs), demo):
        (default if given is None else given).write.mode("overwrite").parquet(f"{base}/{name}")
    return base


def test_production_run_versions_providers(spark, tmp_path):
    raw, base = str(tmp_path / "raw"), str(tmp_path / "dw")
    run_monthly(spark, use_mock=False, landing=landing(spark, raw), output=base, run=FIRST)
    _, providers, _ = demo_frames(spark)
    moved = providers.withColumn("region", F.when(F.col("prestador_id") == "H1", "NOA").otherwise(F.col("region")))
    landing(spark, raw, providers=moved)
    run_monthly(spark, use_mock=False, landing=raw, output=base, run=SECOND, snapshot_date=date(2024, 4, 1))
    fact, history, _ = tables(spark, base)
    assert rows(history.filter("prestador_id = 'H1'").select("region", "fecha_inicio", "fecha_fin"), "fecha_inicio") == [
        ("PATAGONIA", date(1900, 1, 1), date(2024, 4, 1)), ("NOA", date(2024, 4, 1), None),
    ]
    seen = fact.filter("prestador_id = 'H1'").join(history, "prestador_sk").select("periodo", "region").distinct()
    assert rows(seen, "periodo") == [("202403", "PATAGONIA"), ("202404", "NOA")]


def test_orphans_point_to_the_unknown_member(spark, tmp_path):
    costs = spark.createDataFrame([("H1", "202401", "M999", 1.0, 1.0, 1), ("P999", "202401", "N10", 1.0, 1.0, 1)], C.COSTS)
    raw, base = landing(spark, str(tmp_path / "raw"), costs=costs), str(tmp_path / "dw")
    result = run_monthly(spark, use_mock=False, landing=raw, output=base, run=FIRST)
    fact, _, _ = tables(spark, base)
    assert fact.filter("medicamento_sk = 'UNKNOWN'").count() == 1
    assert fact.filter("prestador_sk = 'UNKNOWN'").count() == 1
    assert result["smoke"]["integridad_prestador"] == 1


def test_gate_stops_before_any_write(spark, tmp_path):
    demo = demo_frames(spark)
    bad = demo[0].withColumn("precio_ref", F.lit(600_000.0))
    raw, base = landing(spark, str(tmp_path / "raw"), catalogue=bad), tmp_path / "dw"
    with pytest.raises(DataQualityError, match="nomenclador"):
        run_monthly(spark, use_mock=False, landing=raw, output=str(base), run=FIRST, dq_report_path=str(tmp_path / "dq"))
    assert not base.exists()
    with pytest.raises(DataQualityError):
        gate_from_report(spark, str(tmp_path / "dq"))
    result = run_monthly(spark, use_mock=False, landing=raw, output=str(base), run=FIRST, fail_on_dq_error=False)
    assert result["dq"]["nomenclador"]["overall"] == "FAIL" and result["records_fact"] == 6


def test_missing_format_falls_back_to_parquet(spark, tmp_path):
    result = run_monthly(spark, output=str(tmp_path), fmt="bigquery", dataset="dw", run=FIRST)
    assert result["fact"].startswith(str(tmp_path)) and result["records_fact"] == 6


def test_landing_needs_a_folder_and_its_contract(spark, tmp_path):
    with pytest.raises(ValueError):
        run_monthly(spark, use_mock=False)
    text_price = demo_frames(spark)[0].withColumn("precio_ref", F.col("precio_ref").cast("string"))
    with pytest.raises(C.ContractError, match="precio_ref"):
        landing_frames(spark, landing(spark, str(tmp_path), catalogue=text_price))


def test_command_line(spark, tmp_path, capsys):
    from varcost.__main__ import main

    main(["--use-mock", "--output", str(tmp_path), "--output-dq-report", str(tmp_path / "dq"), "--fail-on-dq-error"])
    assert json.loads(capsys.readouterr().out)["records_fact"] == 6
    assert len(gate_from_report(spark, str(tmp_path / "dq"))) == 3
