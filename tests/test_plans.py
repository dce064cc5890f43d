"""Named queries: properties of their results and of their physical plans."""

from __future__ import annotations

import datetime as dt
import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from calzada.operators.filters import filter_traffic
from calzada.plans import analytics, dashboard, etl, forecast
from calzada.sources import schemas
from calzada.sources.catalog import Tables, conform_traffic, open_tables, register_views


def plan(df) -> str:
    """The plan as it was run."""
    df.collect()
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    """The traffic table as the ETL leaves it: Parquet by year, index included."""
    from calzada.sources.writers import write_parquet_by_year

    path = str(tmp_path_factory.mktemp("t") / "trafico")
    write_parquet_by_year(tables.indexed, path)
    return spark.read.parquet(path)


def traffic(spark, rows):
    return conform_traffic(spark.createDataFrame(
        rows, "comuna string, corredor string, hora int, velocidad_kmh double, intensidad_veh_h int, ocupacion double"))


def test_reduced_join_equals_the_unreduced_one(spark):
    t = traffic(spark, [(f"c{i % 3}", [None, "a", "b", "x"][i % 4], i % 24, float(i), i if i % 5 else None, 1.0) for i in range(60)])
    inc = spark.createDataFrame([(i, ["a", "b", "z", None][i % 4], i) for i in range(40)], "id long, ubicacion string, conteo_vehicular int")
    got = analytics.traffic_and_incidents(t, inc)
    naive = t.join(inc, t["corredor"] == inc["ubicacion"], "left").groupBy("comuna", "corredor").agg(
        F.round(F.avg("velocidad_kmh"), 1).alias("velocidad_trafico"), F.round(F.avg("intensidad_veh_h"), 0).alias("volumen_trafico"),
        F.countDistinct("id").alias("total_incidentes"), F.round(F.avg("conteo_vehicular"), 0).alias("vehiculos_afectados_incidentes"))
    assert sorted(map(str, got.collect())) == sorted(map(str, naive.select(got.columns).collect()))


def test_scaling_by_a_maximum_of_zero(spark):
    t = traffic(spark, [("c", "a", 1, 10.0, 0, 1.0), ("c", "a", 2, 10.0, None, 1.0)])
    assert [(r.hora, r.intensidad_norm) for r in dashboard.hourly_profile(t).collect()] == [(1, None), (2, None)]


def months(spark, rows):
    return spark.createDataFrame(rows, "anio int, mes_num int, intensidad_veh_h double")


def test_forecast_of_a_single_month_is_flat_zero(spark):
    points = forecast.monthly_points(months(spark, [(2020, 3, 5.0)]))
    r = forecast.trend(points).first()
    assert (r.pendiente, r.ordenada, r.meses, r.t_min, r.t_max) == (0.0, 0.0, 1, 3, 3)
    series = forecast.projection(points).collect()
    assert len(series) == 49 and series[0].fecha == dt.date(2020, 3, 31) and series[-1].fecha == dt.date(2024, 3, 31)
    assert [s.tipo for s in series].count("Histórico") == 10


def test_forecast_with_a_gap_and_month_zero(spark):
    rows = [(2019, 0, 10.0), (2019, 1, 12.0), (2020, 6, 46.0), (2020, 7, None)]
    points = forecast.monthly_points(months(spark, rows))
    assert sorted((r.t, r.intensidad) for r in points.collect()) == [(0, 10.0), (1, 12.0), (18, 46.0)]
    r = forecast.trend(points).first()
    assert (r.pendiente, r.ordenada) == pytest.approx((2.0, 10.0))
    assert {str(p.fecha) for p in forecast.with_dates(points).collect()} == {"2019-01-01", "2020-06-01"}
    last = forecast.projection(points).collect()[-1]
    assert (last.t, last.intensidad, last.fecha) == (66, 142.0, dt.date(2024, 6, 30))


def test_forecast_without_months(spark):
    assert forecast.projection(forecast.monthly_points(months(spark, [(2020, 1, None)]))).collect() == []


def test_index_is_in_range_or_missing(tables):
    r = tables.indexed.agg(F.min("indice_congestion").alias("lo"), F.max("indice_congestion").alias("hi"),
                           F.count_if(F.col("indice_congestion").isNull() != F.col("ocupacion").isNull()).alias("odd")).first()
    assert r.lo >= 0 and r.hi <= 1 and r.odd == 0


def test_headline_of_one_corridor(tables):
    rows = dashboard.map_table(tables.indexed, tables.coordenadas)
    one = dashboard.corridor_headline(rows, "Brand#12").collect()
    first = rows.where(F.col("corredor") == "Brand#12").orderBy("comuna").first()
    assert [(r.corredor, r.comuna, r.velocidad) for r in one] == [("Brand#12", first.comuna, first.velocidad)]


def test_catalogue_prefers_parquet(spark, tables, tmp_path):
    path = str(tmp_path / "inc")
    tables.incidentes.limit(5).write.parquet(path)
    found = open_tables(spark, {"incidentes": path}, {"trafico": lambda: tables.trafico, "coordenadas": lambda: tables.coordenadas,
                                                      "incidentes": lambda: tables.incidentes})
    assert isinstance(found, Tables) and found.incidentes.count() == 5
    register_views(found, "cat_")
    assert spark.table("cat_incidentes").count() == 5
    with pytest.raises(KeyError):
        open_tables(spark)


def test_union_of_years_matches_columns_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "anio int, c string"), spark.createDataFrame([("y", 2)], "c string, anio int")
    got = [(r.anio, r.c) for r in etl.union_years(a, b, a.drop("c")).collect()]
    assert sorted(got, key=str) == [(1, "x"), (1, None), (2, "y")]


def test_tables_have_the_declared_types(tables):
    for df, schema in ((tables.incidentes, schemas.INCIDENTS), (tables.coordenadas, schemas.COORDINATES),
                       (analytics.critical_zones(tables.trafico), schemas.CRITICAL_ZONES), (tables.located, schemas.COORDINATES)):
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]
    declared = {f.name: f.dataType for f in schemas.TRAFFIC}
    assert all(declared[f.name] == f.dataType for f in tables.indexed.schema if f.name in declared)


# Physical plans

def test_filters_and_columns_reach_the_scan(stored):
    text = plan(analytics.yearly_summary(filter_traffic(stored, years=[1996, 1998], corridors=["Brand#12"])))
    assert re.search(r"PartitionFilters: \[.*anio#\d+ IN \(1996,1998\)", text)
    assert "PushedFilters: [IsNotNull(corredor), EqualTo(corredor,Brand#12)]" in text or "In(corredor" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"corredor", "velocidad_kmh", "intensidad_veh_h"}


def test_scaled_figures_read_a_summary_instead_of_the_readings_twice(stored):
    for df, name in ((analytics.slower_than_average(stored), "zones"), (dashboard.hourly_profile(stored), "hours"),
                     (forecast.monthly_points(stored), "months")):
        scans = re.findall(r"Location: .*\[(.*)\]", plan(df))
        assert scans and all(f"/{name}-" in s for s in scans)


def test_no_query_multiplies_rows(spark, tables, stored):
    inc, coord = tables.incidentes, tables.coordenadas
    mapped = dashboard.map_table(stored, coord)
    for df in (analytics.traffic_and_incidents(stored, inc), analytics.general_kpis(stored, inc), analytics.slower_than_average(stored),
               dashboard.incident_overlay(inc, coord), dashboard.traffic_vs_incidents(inc, mapped), dashboard.incident_map(inc, coord)):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_ranking_is_limited_before_the_shuffle(stored):
    assert "WindowGroupLimit" in plan(analytics.busiest_days(stored))


def test_top_k_does_not_sort_everything(stored):
    assert "TakeOrderedAndProject" in plan(dashboard.top_by_volume(stored))


def test_index_needs_no_shuffle_of_the_readings(stored):
    from calzada.operators.congestion import congestion_index

    text = plan(congestion_index(stored).select("anio", "indice_congestion"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_no_python_in_any_plan(stored, tables):
    for df in (analytics.congestion_by_zone(stored), dashboard.map_table(stored, tables.coordenadas), tables.cleaned, tables.located):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)
