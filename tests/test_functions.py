"""Column expressions on small literal frames; expected values worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from calzada.functions import dates, numbers, projection, text, traffic


def values(spark, cells, expr, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_cell(spark):
    assert values(spark, [" a b ", None, "", "\t\n ", " x"], text.clean_cell) == ["a b", "", "", "", "x"]


CELLS = [" av. 80-regional ", "calle 10a", "ÑUTIBARA", "o'neil d'ÁVILA", "a_b.c/d", "", "10a20b é1é", "LAURELES - estadio"]


def test_title_case_is_pythons(spark):
    assert values(spark, CELLS, text.title_case) == [c.title() for c in CELLS]


@pytest.mark.parametrize("null_text, title, upper, plain",
                         [("null", None, None, None), ("pandas", "Nan", "NAN", "nan"), ("empty", "", "", "")])
def test_missing_text(spark, null_text, title, upper, plain):
    assert values(spark, [None], lambda c: text.normal_title(c, null_text)) == [title]
    assert values(spark, [None], lambda c: text.normal_upper(c, null_text)) == [upper]
    assert values(spark, [None], lambda c: text.normal_plain(c, null_text)) == [plain]


def test_null_text_is_checked():
    with pytest.raises(ValueError):
        text.normal_title(F.lit("a"), "nada")


NUMBERS = ["7.9", "abc", "nan", "", None, "-3", " 12 ", "1d", "0x1p3", "1e3", "inf", ".5", "5."]


def test_to_number(spark):
    assert values(spark, NUMBERS, numbers.to_number) == [
        7.9, None, None, None, None, -3.0, 12.0, None, None, 1000.0, None, 0.5, 5.0]


def test_to_int_truncates_and_defaults(spark):
    assert values(spark, NUMBERS, numbers.to_int) == [7, 0, 0, 0, 0, -3, 12, 0, 0, 1000, 0, 0, 5]
    assert values(spark, ["x", "2"], lambda c: numbers.to_int(c, F.lit(2020))) == [2020, 2]
    assert values(spark, ["1e12"], lambda c: numbers.to_int(c, None)) == [None]


def test_clips_keep_missing(spark):
    cells = [None, -1.0, 0.5, 3.0]
    assert values(spark, cells, numbers.unit_clip, "double") == [None, 0.0, 0.5, 1.0]
    assert values(spark, cells, numbers.upper_clip, "double") == [None, -1.0, 0.5, 1.0]


def test_finite(spark):
    assert values(spark, [1.0, None, float("nan"), float("inf"), float("-inf")], numbers.finite, "double") == [
        True, False, False, False, False]


def test_percent_of_nothing_is_missing(spark):
    assert spark.range(1).select(numbers.percent(F.lit(1), F.lit(0)).alias("p")).first().p is None


def test_month_number(spark):
    assert values(spark, ["Enero", "DICIEMBRE", " mayo ", "xx", None], dates.month_number) == [1, 12, 5, 0, 0]


def test_dates(spark):
    cells = ["2021-03-04 05:06:07", "2021-13-01", "nope", None]
    assert values(spark, cells, dates.to_timestamp) == [dt.datetime(2021, 3, 4, 5, 6, 7), None, None, None]
    assert values(spark, cells, dates.to_date) == [dt.date(2021, 3, 4), None, None, None]


def test_month_end(spark):
    got = values(spark, [1, 2, 12, 14, 26, 0], lambda t: dates.month_end(F.lit(2019), t), "int")
    assert got == [dt.date(2019, 1, 31), dt.date(2019, 2, 28), dt.date(2019, 12, 31), dt.date(2020, 2, 29),
                   dt.date(2021, 2, 28), dt.date(2018, 12, 31)]


HOURS = [-1, 0, 5, 6, 9, 10, 11, 12, 16, 17, 20, 21, 23, 24, None]


def test_day_period(spark):
    assert values(spark, HOURS, traffic.day_period, "int") == [
        None, "Madrugada", "Madrugada", "Mañana", "Mañana", "Mañana", "Mañana", "Tarde", "Tarde", "Tarde", "Noche",
        "Noche", "Noche", None, None]


def test_rush_hour(spark):
    assert values(spark, HOURS[:-1], traffic.rush_hour, "int") == [
        False, False, False, True, True, False, False, False, False, True, True, False, False, False]


def test_field_order(spark):
    assert values(spark, ["Leve", "Crítico", "?", None], lambda c: traffic.field_order(c, traffic.SEVERITIES)) == [3, 1, 0, 0]


def test_named(spark):
    assert values(spark, ["a", "", "Nan", "None", None], traffic.named) == [True, False, False, False, False]


def test_projection_round_trip(spark):
    points = [(6.2442, -75.5812), (6.0, -75.8), (6.5, -75.3), (4.6, -74.0)]
    grid = spark.createDataFrame([(*p, *projection.to_grid(*p)) for p in points], "la double, lo double, n double, e double")
    lat, lon = projection.from_grid(F.col("n"), F.col("e"))
    for r in grid.select("la", "lo", lat.alias("a"), lon.alias("b")).collect():
        assert abs(r.a - r.la) < 1e-9 and abs(r.b - r.lo) < 1e-9


def test_grid_origin_is_the_false_origin():
    north, east = projection.to_grid(projection.ORIGIN_LAT, projection.ORIGIN_LON)
    assert abs(north - 1_000_000) < 1e-6 and abs(east - 1_000_000) < 1e-6


def test_folded_text_ignores_case_and_accents(spark):
    assert values(spark, ["CRITICO", "crítico", "Leve"], lambda c: text.folded(c) == "Crítico") == [True, True, False]
