from datetime import datetime

from conftest import plan_of, rows

from varcost.contracts import CATALOGUE, PROVIDERS
from varcost.operators import cleaning

DAY1, DAY2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def catalogue(spark, *data):
    return spark.createDataFrame(list(data), CATALOGUE)


def test_demo_catalogue_keeps_the_latest_price(demo):
    got = cleaning.clean_catalogue(demo[0])
    assert rows(got.select("codigo_sns", "precio_ref"), "codigo_sns") == [
        ("N10", 432.0), ("N20", 15200.0), ("N30", 5100.0),
    ]
    assert {r["_source"] for r in got.collect()} == {"nomenclador_nacional"}
    assert got.filter("_ingestion_ts IS NULL").count() == 0


def test_spellings_of_one_code_compete(spark):
    raw = catalogue(
        spark,
        (" m001", "a", "L", 1.0, "U", True, DAY1),
        ("M001", "b", "L", 2.0, "U", True, DAY2),
    )
    assert rows(cleaning.clean_catalogue(raw).select("codigo_sns", "precio_ref")) == [("M001", 2.0)]


def test_an_invalid_latest_state_removes_the_code(spark):
    raw = catalogue(
        spark,
        ("A", "a", "L", 1.0, "U", True, DAY1), ("A", "a", "L", 1.0, "U", False, DAY2),
        ("B", "b", "L", 1.0, "U", True, DAY1), ("B", "b", "L", 0.0, "U", True, DAY2),
        ("C", "c", "L", 0.01, "U", True, DAY1), ("C", "c", "L", 0.01, "U", True, None),
    )
    assert rows(cleaning.clean_catalogue(raw).select("codigo_sns")) == [("C",)]


def test_defaults_case_and_blank_text(spark):
    raw = catalogue(
        spark,
        ("A", "IBUPROFENO 400MG de-luxe ", None, 5.0, None, True, DAY1),
        ("B", "x", "", 5.0, "", True, DAY1),
    )
    got = rows(cleaning.clean_catalogue(raw).select("nombre", "laboratorio", "unidad_medida"), "nombre")
    assert got == [("Ibuprofeno 400mg De-luxe", "SIN DATO", "UN"), ("X", "", "")]


def test_nan_price_passes_the_minimum(spark):
    raw = catalogue(spark, ("A", "a", "L", float("nan"), "U", True, DAY1))
    assert cleaning.clean_catalogue(raw).count() == 1


def test_ties_are_broken_by_content_whatever_the_order(spark):
    tied = [("A", "a", "L", 1.0, "U", True, DAY1), ("A", "a", "L", 3.0, "U", True, DAY1), ("A", "z", "L", 2.0, "U", True, DAY1)]
    results = {
        cleaning.clean_catalogue(catalogue(spark, *order).repartition(3)).first()["precio_ref"]
        for order in (tied, tied[::-1])
    }
    assert len(results) == 1


def test_demo_providers(demo):
    got = cleaning.clean_providers(demo[1])
    assert rows(got.select("prestador_id", "cuit", "cuit_valido", "region"), "prestador_id") == [
        ("H1", "33500012349", True, "PATAGONIA"), ("H2", "33500056781", True, "CUYO"),
    ]
    assert {r["_source"] for r in got.collect()} == {"listado_prestadores"}


def test_region_and_tax_id_edges(spark):
    raw = spark.createDataFrame(
        [("1", "a", None, None, True, None), ("2", "b", None, " cuyo ", True, "20-1"), ("3", "c", None, "Mars", True, "")],
        PROVIDERS,
    )
    got = rows(cleaning.clean_providers(raw).select("region", "cuit", "cuit_valido", "prestador_id"), "prestador_id")
    assert [r[:3] for r in got] == [("OTRAS", None, None), ("CUYO", "201", False), ("OTRAS", "", False)]


def test_dedup_precedes_the_enabled_filter(spark):
    raw = spark.createDataFrame(
        [("1", "old", None, None, True, None, 0), ("1", "new", None, None, False, None, 1)],
        "prestador_id string, nombre string, especialidad string, region string, habilitado boolean, cuit string, ver int",
    )
    assert cleaning.clean_providers(raw, ["ver"]).count() == 0
    assert rows(cleaning.normalise_providers(raw, ["ver"]).select("nombre")) == [("new",)]


def test_a_hot_code_is_reduced_before_the_shuffle(demo):
    plan = plan_of(cleaning.clean_catalogue(demo[0]))
    above, below = plan.split("Exchange", 1)
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below
