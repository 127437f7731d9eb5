"""Loading features: contracts per file, monthly trends, quarantine, catalogue tables, buckets, ledger."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from varcost.contracts import COSTS, ContractError
from varcost.operators import quarantine, scd2, variance
from varcost.operators.quality import DataQualityError
from varcost.operators.star import Run
from varcost.plans.monthly import run_monthly
from varcost.plans.trends import load_trends
from varcost.sinks import buckets, ledger, writers
from varcost.sources.footers import contract_problems
from varcost.sources.readers import read_parquet

from conftest import rows

COST = "prestador_id string, periodo string, codigo_sns string, costo_real double, costo_ppto double, cantidad int"


def costs(spark, *data):
    return spark.createDataFrame([(p, m, c, float(a), b if b is None else float(b), 1) for p, m, c, a, b in data], COST)


# Contracts of files ------------------------------------------------------------------------


def landing(spark, base, **frames):
    for frame in frames.values():
        frame.coalesce(1).write.mode("append").parquet(base)
    return base


def test_every_file_is_compared_with_the_contract(spark, tmp_path, demo):
    good = demo[2]
    base = landing(
        spark, f"{tmp_path}/bad", a=good, b=good.drop("costo_ppto"), c=good.withColumn("cantidad", F.col("cantidad").cast("long")),
        d=good.withColumn("nota", F.lit("x")),
    )
    files = spark.read.parquet(base).inputFiles()
    found = contract_problems(spark, files, COSTS).drop("file").collect()
    assert sorted(map(tuple, found), key=str) == [
        (6, "cantidad", "mistyped", "bigint"), (6, "costo_ppto", "missing", None), (6, "nota", "extra", "string"),
    ]
    with pytest.raises(ContractError, match="costo_ppto is missing"):
        read_parquet(spark, base, COSTS)


def test_a_missing_column_of_one_file_raises_whatever_file_gives_the_schema(spark, tmp_path, demo):
    base = landing(spark, f"{tmp_path}/t", a=demo[2], b=demo[2].drop("costo_ppto"))
    with pytest.raises(ContractError):
        read_parquet(spark, base, COSTS)
    extra = landing(spark, f"{tmp_path}/extra", a=demo[2], b=demo[2].withColumn("nota", F.lit("x")))
    assert read_parquet(spark, extra, COSTS).count() == 12


def test_folder_columns_and_timestamps_are_no_departures(spark, tmp_path, demo):
    demo[2].write.partitionBy("periodo").parquet(f"{tmp_path}/parts")
    files = spark.read.parquet(f"{tmp_path}/parts").inputFiles()
    assert contract_problems(spark, files, COSTS, ["periodo"]).count() == 0
    demo[0].repartition(2).write.parquet(f"{tmp_path}/stamps")
    assert read_parquet(spark, f"{tmp_path}/stamps", demo[0].schema).count() == demo[0].count()
    assert contract_problems(spark, [], COSTS).count() == 0


# Trends over loads -------------------------------------------------------------------------


def random_costs(seed, months=8):
    rng = random.Random(seed)
    out = []
    for p in range(4):
        for c in range(3):
            for m in range(1, months + 1):
                if rng.random() < 0.6:
                    out.append((f"P{p}" if p else None, f"2024{m:02d}", f"C{c}", rng.randint(50, 150), rng.choice([100, 0, 80])))
    return out


def trends_of(df):
    return sorted(rows(df.select("prestador_id", "codigo_sns", "periodo", "desvio_pct", "tendencia")), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_monthly_loads_have_the_trends_of_one_load(spark, tmp_path, seed):
    data = random_costs(seed, months=5)
    scored = variance.with_ratio(costs(spark, *data)).cache()
    for month in sorted({r[1] for r in data}):
        table = load_trends(scored.filter(F.col("periodo") == month), f"{tmp_path}/t", month)
    assert trends_of(table) == trends_of(variance.with_trend(scored))


def test_an_old_month_loaded_again_corrects_later_ones(spark, tmp_path):
    before, after = random_costs(3, months=5), random_costs(3, months=5)
    # In the repaired month amounts change, one series is gone, and one is new.
    after = [(p, m, c, 400 - a if m == "202402" else a, b) for p, m, c, a, b in after]
    gone = next(r for r in after if r[1] == "202402")
    after = [r for r in after if r[:3] != gone[:3]] + [("P9", "202402", "C0", 100, 100)]
    path = f"{tmp_path}/t"
    load_trends(variance.with_ratio(costs(spark, *before)), path, "all")
    scored = variance.with_ratio(costs(spark, *after)).cache()
    table = load_trends(scored.filter("periodo = '202402'"), path, "repair")
    assert trends_of(table) == trends_of(variance.with_trend(scored))
    # Months that are newer than the repair follow the new carry.
    more = variance.with_ratio(costs(spark, *after, ("P9", "202409", "C0", 130, 100))).cache()
    table = load_trends(more.filter("periodo = '202409'"), path, "next")
    assert trends_of(table) == trends_of(variance.with_trend(more))


def test_last_month_loaded_again_without_a_series(spark, tmp_path):
    path = f"{tmp_path}/t"
    data = [("P1", "202401", "C", 110, 100), ("P1", "202402", "C", 150, 100), ("P2", "202402", "C", 90, 100)]
    load_trends(variance.with_ratio(costs(spark, *data)), path, "a")
    load_trends(variance.with_ratio(costs(spark, ("P2", "202402", "C", 90, 100))), path, "b")
    table = load_trends(variance.with_ratio(costs(spark, ("P1", "202403", "C", 120, 100))), path, "c")
    got = {(r["prestador_id"], r["periodo"]): r["tendencia"] for r in table.collect()}
    # Compared with January, as February no longer has the series.
    assert got == {("P1", "202401"): "NUEVO", ("P2", "202402"): "NUEVO", ("P1", "202403"): "EMPEORA"}


def run_at(month):
    return Run(datetime(2024, month, 1))


def land(spark, base, frame, demo):
    demo[0].write.parquet(f"{base}/nomenclador")
    demo[1].write.parquet(f"{base}/prestadores")
    frame.write.parquet(f"{base}/costos")
    return base


def fact_trends(spark, out):
    fact = spark.read.parquet(f"{out}/fact_costos_prestacionales")
    return sorted((r["prestador_id"], r["codigo_sns"], str(r["periodo"]), r["tendencia"]) for r in fact.collect())


def test_monthly_runs_keep_trends_and_observe_the_fact_in_flight(spark, tmp_path, demo, monkeypatch):
    monkeypatch.setattr(writers.Written, "read", lambda *a: pytest.fail("the fact is read back"))
    out = f"{tmp_path}/dw"
    for k, month in enumerate(("202403", "202404")):
        raw = land(spark, f"{tmp_path}/{month}", demo[2].filter(F.col("periodo") == month), demo)
        result = run_monthly(spark, use_mock=False, landing=raw, output=out, run=run_at(3 + k))
    assert result["records_fact"] == 2
    assert result["smoke"] == {"integridad_prestador": 0, "alertas_sin_desvio": 0} and result["unknown_drugs"] == 0
    got = {r[:3]: r[3] for r in fact_trends(spark, out)}
    assert got["H1", "N10", "202404"] == "MEJORA" and got["H2", "N20", "202404"] == "EMPEORA"
    # March again, with H1's drug far below budget: April is worse now.
    repaired = demo[2].filter("periodo = '202403'").withColumn("costo_real", F.when(F.col("codigo_sns") == "N10", 1000.0).otherwise(F.col("costo_real")))
    raw = land(spark, f"{tmp_path}/again", repaired, demo)
    result = run_monthly(spark, use_mock=False, landing=raw, output=out, run=run_at(5))
    got = {r[:3]: r[3] for r in fact_trends(spark, out)}
    assert result["records_fact"] == 4 and len(got) == 6
    assert got["H1", "N10", "202404"] == "EMPEORA" and got["H2", "N20", "202404"] == "EMPEORA"


# Quarantine and gate -----------------------------------------------------------------------


BAD = [
    ("H1", "202403", "N10", 1, 1), (None, "202403", "N10", 1, 1), ("H1", "999999", "N10", 1, 1), ("H2", "202403", "N20", 1, None),
    ("H2", "202404", "N20", 1, 1), ("H2", "202404", "N20", 2, 1), (None, "20240", "N10", 1, 1), ("H3", "202413", None, 1, 1),
]


def test_every_row_is_tagged_with_the_rules_it_breaks(spark):
    df = costs(spark, *BAD)
    tagged = quarantine.tagged(df, [*quarantine.required(COSTS), quarantine.month_rule()], ("prestador_id", "codigo_sns", "periodo"))
    got = {(r["prestador_id"], r["periodo"], r["costo_real"]): r["motivos"] for r in tagged.collect()}
    assert got == {
        ("H1", "202403", 1): [], (None, "202403", 1): ["null:prestador_id"], ("H1", "999999", 1): ["month:periodo"],
        ("H2", "202403", 1): ["null:costo_ppto"], ("H2", "202404", 1): ["grain"], ("H2", "202404", 2): ["grain"],
        (None, "20240", 1): ["null:prestador_id", "month:periodo"], ("H3", "202413", 1): ["null:codigo_sns", "month:periodo"],
    }
    kept, held = quarantine.routed(tagged)
    assert kept.columns == df.columns and kept.count() + held.count() == len(BAD)


def test_the_gate_stops_what_the_contract_forbids(spark, tmp_path, demo):
    raw = land(spark, f"{tmp_path}/raw", costs(spark, *BAD), demo)
    with pytest.raises(DataQualityError, match="costos"):
        run_monthly(spark, use_mock=False, landing=raw, output=f"{tmp_path}/dw", run=run_at(1))
    assert not (tmp_path / "dw").exists()


def test_limits_let_a_share_go_to_quarantine(spark, tmp_path, demo):
    few = [("H1", "202403", "N10", 52000, 40000), ("H2", "202403", "N20", 1, 1), ("H2", "202404", "N20", 9, 9)] * 1
    many = [(f"X{k}", "202403", "N10", 100, 100) for k in range(57)]
    bad = [("H2", "999999", "N20", 1, 1), (None, "202403", "N20", 1, 1), ("X1", "202404", "N10", 5, 5), ("X1", "202404", "N10", 5, 5)]
    raw = land(spark, f"{tmp_path}/raw", costs(spark, *few, *many, *bad), demo)
    limits = {"null:prestador_id": 0.05, "month:periodo": 0.05, "grain": 0.05}
    result = run_monthly(spark, use_mock=False, landing=raw, output=f"{tmp_path}/dw", run=run_at(1), limits=limits)
    held = spark.read.parquet(result["quarantine"])
    assert result["records_fact"] == 60 and held.count() == 4
    assert sorted(r["motivos"][0] for r in held.collect()) == ["grain", "grain", "month:periodo", "null:prestador_id"]
    fact = spark.read.parquet(result["fact"])
    assert fact.filter("prestador_id IS NULL").count() == 0 and fact.select("fact_id").distinct().count() == 60
    assert result["smoke"]["integridad_prestador"] == 57
    with pytest.raises(DataQualityError):
        run_monthly(spark, use_mock=False, landing=raw, output=f"{tmp_path}/dw2", run=run_at(1), limits={**limits, "grain": 0.01})


# Catalogue ---------------------------------------------------------------------------------


def test_tables_and_views_last_over_runs(spark, tmp_path, demo):
    out = f"{tmp_path}/dw"
    for k, month in enumerate(("202403", "202404")):
        raw = land(spark, f"{tmp_path}/{month}", demo[2].filter(F.col("periodo") == month), demo)
        run_monthly(spark, use_mock=False, landing=raw, output=out, run=run_at(3 + k), database="dw_test")
    assert spark.table("dw_test.fact_costos_prestacionales").count() == 6
    assert spark.table("dw_test.dim_prestador").count() == 3 and spark.table("dw_test.dim_medicamento").count() == 3
    months = rows(spark.sql("SELECT periodo_id, total_prestadores, nombre_mes FROM dw_test.v_resumen_desvios_periodo"), "periodo_id")
    assert months == [("202403", 2, "March"), ("202404", 2, "April")]
    top = spark.sql("SELECT * FROM dw_test.v_top_prestadores_desvio WHERE rank_periodo = 1 ORDER BY periodo_id").collect()
    assert [(r["prestador_id"], r["region"]) for r in top] == [("H1", "PATAGONIA"), ("H1", "PATAGONIA")]
    assert not any(t.isTemporary for t in spark.catalog.listTables("dw_test"))


def test_dimensions_go_to_the_chosen_format(spark, tmp_path):
    result = run_monthly(spark, use_mock=True, output=f"{tmp_path}/dw", fmt="notinstalled", dataset="ds", run=run_at(1))
    assert result["fact"] == f"{tmp_path}/dw/fact_costos_prestacionales"
    assert spark.read.parquet(f"{tmp_path}/dw/notinstalled/dim_prestador").count() == 3


# Buckets -----------------------------------------------------------------------------------


def people(spark, *data):
    return spark.createDataFrame(data, "id string, name string")


def written(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_only_buckets_with_changed_keys_are_rewritten(spark, tmp_path):
    path, kind = tmp_path / "dim", dict(key="id", tracked=["name"], sk="sk", buckets=16)
    days = [date(2024, m, 1) for m in (1, 2, 3, 4)]
    base = [(f"k{k}", "a") for k in range(200)] + [(None, "n")]
    snapshots = [base, [(i, "b" if i == "k7" else n) for i, n in base], [r for r in base if r[0] != "k9"] + [("new", "x")], base]
    before = {}
    for day, data in zip(days, snapshots):
        touched = buckets.merge_bucketed(people(spark, *data), str(path), day, **kind)
        after = written(path)
        changed = {f.split("bucket=")[1].split("/")[0] for f in after if before.get(f) != after[f]}
        if before:
            assert changed == {str(b) for b in touched} and 1 <= len(touched) <= 3
        before = after
    assert buckets.merge_bucketed(people(spark, *base), str(path), days[-1], **kind) == [] and written(path) == before
    whole = scd2.history({d: people(spark, *s) for d, s in zip(days, snapshots)}, "id", ["name"], sk="sk")
    got = buckets.read_bucketed(spark, str(path), whole.schema).drop("bucket")
    assert sorted(rows(got), key=str) == sorted(rows(whole), key=str)
    assert buckets.read_bucketed(spark, str(tmp_path / "none"), whole.schema) is None


# Ledger ------------------------------------------------------------------------------------


def test_runs_that_are_repeated_or_broke_leave_one_copy(spark, tmp_path, monkeypatch):
    path, df = f"{tmp_path}/t", spark.createDataFrame([(k, f"2024{k % 3 + 1:02d}") for k in range(30)], "id int, periodo string")
    assert rows(ledger.read_committed(spark, path, df.schema)) == []
    real = ledger._read
    monkeypatch.setattr(ledger, "_read", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")) if (tmp_path / "t/data").exists() else real(*a))
    # A run that breaks after its files are written and before it commits.
    commit = type(df.write).parquet

    def broken(self, target, *a, **b):
        if target.endswith("/ledger"):
            raise RuntimeError("lost")
        return commit(self, target, *a, **b)

    monkeypatch.setattr(type(df.write), "parquet", broken)
    with pytest.raises(RuntimeError):
        ledger.append_once(df, path, "run1")
    monkeypatch.undo()
    assert ledger.read_committed(spark, path, df.schema).count() == 0
    assert ledger.append_once(df, path, "run1") == ["202401", "202402", "202403"]
    assert ledger.append_once(df, path, "run1") == []
    assert sorted(rows(ledger.read_committed(spark, path, df.schema))) == sorted(rows(df))
    # A run loads a month that is new to it; another replaces a month; the same run replaces all of its own.
    more = df.unionByName(spark.createDataFrame([(99, "202404")], df.schema))
    assert ledger.append_once(more, path, "run1") == ["202404"]
    assert ledger.append_once(df.filter("id = 0"), path, "run2") == ["202401"]
    assert ledger.read_committed(spark, path, df.schema).filter("periodo = '202401'").count() == 1
    assert ledger.append_once(more, path, "run1", replace=True) == ["202401", "202402", "202403", "202404"]
    assert sorted(rows(ledger.read_committed(spark, path, df.schema))) == sorted(rows(more))
    assert {r["filas"] for r in ledger.committed(spark, path).collect()} == {10, 1}
    assert ledger.append_once(df.limit(0), path, "run3") == []
