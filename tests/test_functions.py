from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from terrane.functions import columns as C
from terrane.functions.laws import inverse_law, law
from terrane.operators.layers import rounded, viewport


def one(spark, expression, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "want"), [("5.7", 5.7), ("abc", None), (None, None), ("NaN", None), ("", None)])
def test_number(spark, text, want):
    assert one(spark, C.number("v"), text) == want


@pytest.mark.parametrize(("text", "want"), [("2020-01-02", 2), ("20200103", 3), ("2020-01-04T10:00:00", 4), ("x", None), (None, None)])
def test_dates(spark, text, want):
    assert one(spark, C.date_parts("v")["day"], text) == want


@pytest.mark.parametrize(("name", "want"), [("Vulpes vulpes vulpes", "Vulpes vulpes"), ("Vulpes Vulpes vulpes x", "Vulpes Vulpes vulpes x"), ("Vulpes vulpes crucigera", "Vulpes vulpes crucigera"), ("Vulpes", "Vulpes"), (None, None)])
def test_scientific_names(spark, name, want):
    assert one(spark, C.clean_scientific_name("v"), name) == want


@pytest.mark.parametrize(("code", "want"), [("2A | 2B", "2A, 2B"), ("2A", "2A"), ("2B | 13", "2B"), ("01 | 999", "01"), ("", ""), (None, None)])
def test_departments(spark, code, want):
    assert one(spark, C.department_codes("v"), code) == want


@pytest.mark.parametrize(("year", "k"), [(1800, None), (1801, 0), (1990, 0), (1991, 1), (2010, 1), (2011, 2), (2024, 2), (2025, None), (None, None)])
def test_periods_are_open_to_the_left(spark, year, k):
    bounds = [1800, 1990, 2010, 2024]
    assert one(spark, C.period("v", bounds), year, "int") == (None if k is None else C.period_label(bounds, k))


@pytest.mark.parametrize(("value", "direction", "want"), [(0.0, "nearest", 0.0), (-1234.0, "nearest", -1230.0), (999.5, "up", 1000.0), (0.00123456, "down", 0.00123), (None, "nearest", None)])
def test_significant_digits(spark, value, direction, want):
    got = one(spark, C.round_to_significant("v", 3, direction), value, "double")
    assert got is want or math.isclose(got, want, rel_tol=1e-12)
    if value is not None:
        assert math.isclose(rounded(value, 3, direction), want, rel_tol=1e-12)


def test_rounding_needs_a_number_and_a_direction(spark):
    with pytest.raises(ValueError):
        rounded(None)
    with pytest.raises(ValueError):
        rounded(1.0, 3, "sideways")
    with pytest.raises(ValueError):
        C.round_to_significant("v", 3, "sideways")


def test_title_case_and_site_names(spark):
    assert one(spark, C.title_case("v"), "red-tailed o'hara") == "Red-Tailed O'Hara"
    assert one(spark, C.site_name("v"), "Les Écrins [Aire d'adhésion]") == "Les Écrins"
    assert one(spark, C.first_part("v", "|"), " a | b") == "a"


def test_clamped_keeps_null(spark):
    assert one(spark, C.clamped("v", 0, 1), None, "double") is None
    assert one(spark, C.clamped("v", 0, 1), 5.0, "double") == 1.0


@pytest.mark.parametrize("name", ["linear", "power", "exp", "normal"])
def test_inverse_laws(spark, name):
    x = {"normal": 1.3}.get(name, 2.0)
    y = one(spark, law(F.col("v"), name, [1.5, 0.7]), x, "double")
    assert math.isclose(one(spark, inverse_law(F.col("v"), name, [1.5, 0.7]), y, "double"), x, rel_tol=1e-9)


def test_unknown_law(spark):
    with pytest.raises(ValueError):
        inverse_law(F.col("v"), "cubic", [1.0])


def test_viewport():
    assert viewport({"center_x": 2, "center_y": 46, "height": 10, "size_x": 20, "size_y": 10}) == (-8, 12, 41, 51)
