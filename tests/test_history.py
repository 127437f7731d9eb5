from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from varcost.operators import scd2

D1, D2, D3, D4 = (date(2024, m, 1) for m in (1, 3, 5, 7))
SCHEMA = "prestador_id string, region string, habilitado boolean, src string"
TRACKED = ("region", "habilitado")


@pytest.fixture(scope="module")
def snapshots(spark):
    def frame(*data):
        return spark.createDataFrame([(*r, "s") for r in data], SCHEMA)

    return {
        D1: frame(("same", "N", True), ("moves", "N", True), ("leaves", "N", True), ("gap", None, True)),
        D2: frame(("same", "N", True), ("moves", "S", True), ("gap", None, True), ("late", "N", True)),
        D3: frame(("same", "N", True), ("moves", "S", True), ("late", "N", False)),
        D4: frame(("same", "N", True), ("moves", "N", True), ("late", "N", False), ("gap", None, True)),
    }


def versions(df):
    return rows(df.select("prestador_id", "region", "habilitado", "fecha_inicio", "fecha_fin", "es_vigente"),
                "prestador_id", "fecha_inicio")


EXPECTED = [
    ("gap", None, True, D1, D3, False),
    ("gap", None, True, D4, None, True),
    ("late", "N", True, D2, D3, False),
    ("late", "N", False, D3, None, True),
    ("leaves", "N", True, D1, D2, False),
    ("moves", "N", True, D1, D2, False),
    ("moves", "S", True, D2, D4, False),
    ("moves", "N", True, D4, None, True),
    ("same", "N", True, D1, None, True),
]


def incremental(snapshots, days):
    first, *later = days
    dimension = scd2.history({first: snapshots[first]}, tracked=TRACKED, carried=("src",))
    for day in later:
        dimension = scd2.merge_snapshot(dimension, snapshots[day], day, tracked=TRACKED, carried=("src",))
    return dimension


def test_history_from_all_snapshots(snapshots):
    got = scd2.history(snapshots, tracked=TRACKED, carried=("src",))
    assert versions(got) == EXPECTED
    assert got.select("prestador_sk").distinct().count() == len(EXPECTED)
    assert {r["src"] for r in got.collect()} == {"s"}


def test_merging_one_by_one_gives_the_same(snapshots):
    got = incremental(snapshots, [D1, D2, D3, D4])
    whole = scd2.history(snapshots, tracked=TRACKED, carried=("src",))
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(whole)))


def test_merging_again_changes_nothing_and_corrections_replace(snapshots, spark):
    twice = incremental(snapshots, [D1, D2, D3, D4, D4])
    assert versions(twice) == EXPECTED
    fixed = snapshots[D4].withColumn("region", F.when(F.col("prestador_id") == "moves", "W").otherwise(F.col("region")))
    got = scd2.merge_snapshot(twice, fixed, D4, tracked=TRACKED, carried=("src",))
    assert [v for v in versions(got) if v[0] == "moves"] == [
        ("moves", "N", True, D1, D2, False), ("moves", "S", True, D2, D4, False), ("moves", "W", True, D4, None, True),
    ]


def test_an_older_snapshot_is_refused(snapshots):
    dimension = incremental(snapshots, [D1, D2, D3])
    with pytest.raises(Exception, match="older than the version"):
        scd2.merge_snapshot(dimension, snapshots[D2], D2, tracked=TRACKED, carried=("src",)).collect()


def test_one_shuffle_builds_the_history(snapshots):
    plan = scd2.history(snapshots, tracked=TRACKED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_as_of_month(snapshots, spark):
    fact = spark.createDataFrame(
        [("moves", "202401"), ("moves", "202402"), ("moves", "202403"), ("moves", "202406"), ("moves", "202407"),
         ("gap", "202405"), ("leaves", "202402"), ("leaves", "202403"), ("nobody", "202401")],
        "prestador_id string, periodo string",
    )
    history = scd2.history(snapshots, tracked=TRACKED)
    got = rows(scd2.as_of_month(fact, history, columns=("region", "fecha_inicio")), "prestador_id", "periodo")
    assert got == [
        ("gap", "202405", None, None),
        ("leaves", "202402", "N", D1), ("leaves", "202403", None, None),
        ("moves", "202401", "N", D1), ("moves", "202402", "N", D1), ("moves", "202403", "S", D2),
        ("moves", "202406", "S", D2), ("moves", "202407", "N", D4),
        ("nobody", "202401", None, None),
    ]


def test_current_has_one_row_per_live_key(snapshots):
    current = scd2.current(scd2.history(snapshots, tracked=TRACKED))
    assert sorted(r["prestador_id"] for r in current.collect()) == ["gap", "late", "moves", "same"]


def test_null_keys_survive_a_merge_and_new_keys_may_cover_the_past(spark):
    schema = "prestador_id string, nombre string"
    first = spark.createDataFrame([(None, "x"), ("P1", "a")], schema)
    dimension = scd2.history({D1: first}, tracked=("nombre",))
    second = spark.createDataFrame([(None, "x"), ("P1", "a"), ("P2", "b")], schema)
    merged = scd2.merge_snapshot(dimension, second, D2, tracked=("nombre",), new_since=date(1900, 1, 1))
    got = {r["prestador_id"]: r["fecha_inicio"] for r in merged.collect()}
    assert got == {None: D1, "P1": D1, "P2": date(1900, 1, 1)}
    assert scd2.merge_snapshot(merged, second, D3, tracked=("nombre",)).count() == 3


def test_surrogate_keys_tell_null_parts_apart(spark):
    from varcost.functions.keys import surrogate_key

    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "x string, y string")
    assert df.select(surrogate_key(df.x, df.y)).distinct().count() == 3
