"""Frame operators on small literal frames and against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calzada.functions.projection import to_grid
from calzada.operators import cleaning, congestion, filters, geo, profile, sampling
from calzada.operators.quantiles import exact_quantiles
from calzada.sources.readers import drop_empty_rows, pad_columns, rename_by_header
from calzada.sources.schemas import HEADERS, RAW_COLUMNS, TRAFFIC, raw_schema


def raw(spark, *rows, year=2020):
    """Raw text rows given by column name."""
    full = [tuple(r.get(c) for c in RAW_COLUMNS) for r in rows]
    return spark.createDataFrame(full, raw_schema()).withColumn("anio_carpeta", F.lit(year))


def test_clean_types_and_values(spark):
    df = cleaning.clean(raw(spark, {
        "carril": " carril 1 ", "corredor": "av. 80-regional", "hora": "7.9", "anio": "x", "mes": "ENERO", "mes_num": None,
        "velocidad_kmh": "nan", "ocupacion": "5", "categoria_1": "2.7", "categoria_2": "?", "sentido": " n ", "operacion": "ON ",
        "fecha": "2020-01-31", "fecha_trafico": "malo"}))
    assert [f.name for f in df.schema] == [f.name for f in TRAFFIC][:-1]
    assert [f.dataType for f in df.schema] == [f.dataType for f in TRAFFIC][:-1]
    r = df.first()
    assert (r.carril, r.corredor, r.hora, r.anio, r.mes, r.mes_num) == ("Carril 1", "Av. 80-Regional", 7, 2020, "Enero", 1)
    assert (r.velocidad_kmh, r.ocupacion, r.categoria_1, r.categoria_2, r.categoria_3) == (None, 5.0, 2, 0, 0)
    assert (r.sentido, r.operacion, str(r.fecha), r.fecha_trafico) == ("N", "on", "2020-01-31", None)
    assert (r.comuna, r.periodo_dia, r.es_hora_pico) == (None, "Mañana", True)


def test_clean_for_csv(spark):
    r = cleaning.clean_for_csv(raw(spark, {"hora": "x", "mes": "Marzo", "mes_num": "9", "anio": "1999", "corredor": " calle 10a "})).first()
    assert (r.hora, r.mes_num, r.anio, r.corredor, r.comuna) == (0, 3, 2020, "Calle 10A", "")


def test_only_rows_without_any_cell_are_dropped(spark):
    df = raw(spark, {}, {"carril": ""}, {"mes": "Enero"})
    assert drop_empty_rows(df).count() == 2


def test_headers_with_several_spellings(spark):
    df = spark.createDataFrame([("1", None), (None, "2")], "`Intensidad (Veh/h)` string, Intensidad string")
    out = rename_by_header(df)
    assert out.columns == list(RAW_COLUMNS)
    assert sorted(r.intensidad_veh_h for r in out.collect()) == ["1", "2"]
    assert sum(len(v) for v in HEADERS.values()) == 47


def test_padding_keeps_the_order(spark):
    df = pad_columns(spark.createDataFrame([("a", "b")], raw_schema(2)))
    assert df.columns == list(RAW_COLUMNS) and df.first().codigo_comuna is None


def occupancy(spark, cells):
    return spark.createDataFrame([(i, y, v) for i, (y, v) in enumerate(cells)], "i int, anio int, ocupacion double")


def test_index_p95_per_year(spark):
    cells = [(2019, v) for v in (None, 0.0, 5.0, 100.0, 999.0, 1000.0, -2.0)] + [(2020, 0.0)] * 3 + [(2021, None)] * 2
    got = congestion.congestion_index(occupancy(spark, cells)).orderBy("i").collect()
    p95 = np.percentile([0, 5, 100, 999, 1000, -2], 95)
    want = [None, 0.0, 5 / p95, 100 / p95, min(999 / p95, 1), 1.0, 0.0] + [0.0] * 5
    assert [r.indice_congestion for r in got] == pytest.approx(want)


def test_index_over_largest_valid_occupancy(spark):
    cells = [(2019, v) for v in (None, 0.0, 5.0, 999.0, 1000.0, -2.0)]
    got = congestion.congestion_index(occupancy(spark, cells), "max_valid").orderBy("i").collect()
    assert [r.indice_congestion for r in got] == pytest.approx([None, 0.0, 5 / 999, 1.0, 1.0, -2 / 999])
    none_valid = congestion.congestion_index(occupancy(spark, [(2019, 0.0), (2019, None)]), "max_valid")
    assert [r.indice_congestion for r in none_valid.orderBy("i").collect()] == [0.0, None]


def test_index_over_maximum(spark):
    got = congestion.congestion_index(occupancy(spark, [(2019, 5.0), (2019, -5.0), (2019, 10.0)]), "max").orderBy("i").collect()
    assert [r.indice_congestion for r in got] == [0.5, 0.0, 1.0]
    with pytest.raises(ValueError):
        congestion.congestion_index(occupancy(spark, [(2019, 5.0)]), "otro")


def test_index_is_repaired_only_when_it_adds_up_to_zero(spark):
    df = occupancy(spark, [(2019, 5.0), (2019, 10.0), (2019, None)])
    broken = congestion.repair_index(df.withColumn("indice_congestion", F.lit(0.0))).orderBy("i").collect()
    assert [r.indice_congestion for r in broken] == [0.5, 1.0, None]
    sound = congestion.repair_index(df.withColumn("indice_congestion", F.lit(0.25))).collect()
    assert {r.indice_congestion for r in sound} == {0.25}
    empty = congestion.repair_index(df.withColumns({"ocupacion": F.lit(0.0), "indice_congestion": F.lit(0.0)})).collect()
    assert {r.indice_congestion for r in empty} == {0.0}


def test_quantiles_match_brute_force(spark):
    rng = random.Random(3)
    groups = {
        "plano": [7.0] * 50, "uno": [3.5], "dos": [1.0, 2.0],
        "libre": [rng.gauss(0, 1e3) for _ in range(900)],
        "cola": [rng.paretovariate(0.5) for _ in range(700)],
        "caliente": [float(rng.randrange(5)) for _ in range(3000)],
        "lejos": [0.0, 1.0, 2.0, 1e308], "extremos": [-1.7e308, 1.0, 2.0, 3.0, 1.7e308],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("libre", None), ("libre", float("nan")), ("libre", float("inf")), ("dos", float("-inf")), ("nada", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    qs = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {(r.g, r.q): r.valor for r in exact_quantiles(df, "g", "v", qs).collect()}
    want = {(g, q): float(np.percentile(vs, q * 100)) for g, vs in groups.items() for q in qs}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-12, abs_tol=1e-9), (k, got[k], v)


def test_first_coordinates_prefer_a_located_reading(spark):
    df = spark.createDataFrame([("a", "x", None, None), ("a", "x", 2.0, 9.0), ("a", "x", 1.0, 5.0), ("b", None, None, None)],
                               "corredor string, comuna string, latitud double, longitud double")
    got = {(r.corredor, r.comuna): (r.latitud, r.longitud) for r in geo.first_coordinates(df).collect()}
    assert got == {("a", "x"): (1.0, 5.0), ("b", None): (None, None)}


def test_every_corridor_is_located(spark):
    north, east = to_grid(6.2442, -75.5812)
    rows = [
        ("punto", "Otra", north, east), ("punto", "Lejos", None, None),       # mean of the corridor
        ("cero", "El Poblado", 0.0, 0.0), ("nada", "Barrio POBLADO sur", None, None),  # district
        ("fuera", "Bogotá", 1_000_000.0, 1_000_000.0), ("texto", "None", None, None), ("vacio", "", None, None),
        (None, None, None, None),                                              # city centre
    ]
    df = spark.createDataFrame(rows, "corredor string, comuna string, latitud double, longitud double")
    got = {(r.corredor, r.comuna): (r.latitud, r.longitud) for r in geo.corridor_coordinates(df).collect()}
    assert len(got) == len(rows)
    assert got["punto", "Otra"] == (6.2442, -75.5812) and got["punto", "Lejos"] == pytest.approx((6.2442, -75.5812))
    assert got["cero", "El Poblado"] == (6.21, -75.565) == got["nada", "Barrio POBLADO sur"]
    for k in (("fuera", "Bogotá"), ("texto", "None"), ("vacio", ""), (None, None)):
        assert got[k] == geo.CITY_CENTRE


def test_first_listed_district_name_counts(spark):
    df = spark.createDataFrame([("Laureles - Estadio",), ("laureles",), ("La Candelaria",), ("popular belen",), (None,)], "c string")
    got = [r.p and (r.p.latitud, r.p.longitud) for r in df.select(geo.district_point(F.col("c")).alias("p")).collect()]
    assert got == [(6.25, -75.59), (6.25, -75.59), (6.245, -75.57), (6.23, -75.6), None]


def test_one_point_per_corridor(spark):
    df = spark.createDataFrame([(" Calle 1", "b", 2.0, 2.0), (" Calle 1", "a", 1.0, 9.0)],
                               "corredor string, comuna string, latitud double, longitud double")
    assert [tuple(r) for r in geo.one_point_per_corridor(df).collect()] == [("calle 1", " Calle 1", 1.0, 9.0)]


def test_filters(spark):
    df = spark.createDataFrame([(2019, "a", "Tarde"), (2020, "b", "Noche"), (2020, None, None)], "anio int, corredor string, periodo_dia string")
    assert filters.filter_traffic(df).count() == 3
    assert filters.filter_traffic(df, years=[2020]).count() == 2
    assert filters.filter_traffic(df, corridors=["a", "o'b"]).count() == 1
    assert filters.filter_traffic(df, years=[2020], period="Noche").count() == 1


def test_inside_city_includes_the_border(spark):
    df = spark.createDataFrame([(6.0, -75.8), (6.5, -75.3), (6.51, -75.5), (None, -75.5)], "latitud double, longitud double")
    assert filters.inside_city(df).count() == 2


def test_samples(spark):
    df = spark.range(1000)
    assert sampling.modulus_sample(df, 0.2).count() == 200
    assert sampling.modulus_sample(df, 1.0).count() == 1000
    n = sampling.random_sample(df).count()
    assert 90 < n < 220 and n == sampling.random_sample(df).count()


def test_null_profile_and_value_counts(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), (None, None), ("b", 2)], "x string, y int")
    assert {r.columna: (r.nulos, r.porcentaje) for r in profile.null_profile(df).collect()} == {"x": (1, 25.0), "y": (2, 50.0)}
    assert [tuple(r) for r in profile.value_counts(df, "x").collect()] == [("a", 2), ("b", 1)]


def test_describe(spark):
    vals = [1.0, 2.0, 4.0, 8.0, None]
    r = profile.describe(spark.createDataFrame([(v, "t") for v in vals], "v double, t string")).first()
    known = np.array(vals[:-1])
    assert tuple(r)[:2] == ("v", 4)
    assert tuple(r)[2:] == pytest.approx((known.mean(), known.std(ddof=1), 1, *np.percentile(known, [25, 50, 75]), 8), abs=1e-6)


def test_narrow_types(spark):
    df = spark.createDataFrame([(2020, 7, 300, 1.5)], "anio int, hora int, otro int, v double")
    assert dict(cleaning.narrow_types(df).dtypes) == {"anio": "smallint", "hora": "tinyint", "otro": "int", "v": "float"}
    assert cleaning.smallest_integers(df) == {"anio": "smallint", "hora": "tinyint", "otro": "smallint"}


def test_incident_coercion(spark):
    df = spark.createDataFrame([("2020-01-02 03:04:05", "7", "x"), ("ayer", None, "5.5")],
                               "fecha_incidente string, conteo_vehicular string, velocidad_promedio string")
    got = [(r.fecha_incidente is not None, r.conteo_vehicular, r.velocidad_promedio) for r in cleaning.clean_incidents(df).collect()]
    assert got == [(True, 7, None), (False, 0, 5.5)]
