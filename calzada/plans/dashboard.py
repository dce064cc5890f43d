"""The tables behind the dashboard's charts.

Charts leave out rows whose group key is missing, so these queries do too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calzada.functions.dates import MONTHS, WEEKDAYS
from calzada.functions.numbers import stable
from calzada.functions.text import match_key
from calzada.functions.traffic import SEVERITIES, field_order, slower_than
from calzada.operators.filters import inside_city, known_keys, named_corridors
from calzada.operators.geo import one_point_per_corridor
from calzada.sources.workspace import materialise

CRAWL_KMH = 20
SAMPLE_ROWS = 500


def _even(c: Column, digits: int) -> Column:
    """Half-even rounding that a different summation order cannot tip over."""
    return F.bround(stable(c), digits)


def kpis(trafico: DataFrame, rounded: bool = True) -> DataFrame:
    """Headline figures; the rounded form is the one a SQL source shows."""
    index = stable(F.avg("indice_congestion") * 100)
    speed, flow = F.avg("velocidad_kmh"), F.avg("intensidad_veh_h")
    if rounded:
        index, speed, flow = F.round(index, 1), F.round(speed, 1), F.round(flow, 0)
    return trafico.agg(F.count("*").alias("total_reg"), speed.alias("vel_media"), flow.alias("int_media"),
                       index.alias("cong_media"))


def year_options(trafico: DataFrame) -> DataFrame:
    return trafico.select("anio").distinct().orderBy("anio")


def corridor_options(trafico: DataFrame) -> DataFrame:
    c = F.col("corredor")
    return trafico.where(c.isNotNull() & ~c.isin("", "Nan")).select("corredor").distinct().orderBy("corredor")


def hourly_profile(trafico: DataFrame) -> DataFrame:
    """Mean speed and flow per hour, and the flow scaled so that its peak is 60."""
    hours = materialise(known_keys(trafico, "hora").groupBy("hora").agg(
        F.avg("velocidad_kmh").alias("velocidad"), F.avg("intensidad_veh_h").alias("intensidad")), "hours")
    peak = hours.agg(F.max("intensidad").alias("m")).scalar()
    scaled = F.try_divide(F.col("intensidad"), peak) * 60
    return hours.select("hora", "velocidad", "intensidad", scaled.alias("intensidad_norm")).orderBy("hora")


def congestion_by_corridor(trafico: DataFrame, min_count: int = 100, n: int = 15, kmh: float = CRAWL_KMH) -> DataFrame:
    return named_corridors(trafico).groupBy("corredor").agg(
        F.count("velocidad_kmh").alias("total"), slower_than(F.col("velocidad_kmh"), kmh).alias("congested"),
        F.avg("velocidad_kmh").alias("vel_prom"), _even(F.avg("indice_congestion") * 100, 1).alias("idx_cong"),
    ).where(F.col("total") > min_count).orderBy(F.desc("idx_cong"), "corredor").limit(n)


def hour_by_weekday(trafico: DataFrame) -> DataFrame:
    day = F.col("dia_semana")
    return known_keys(trafico, "hora").where(day.isin(*WEEKDAYS)).groupBy("hora", "dia_semana").agg(
        F.avg("intensidad_veh_h").alias("intensidad"),
    ).select("hora", "dia_semana", field_order(day, WEEKDAYS).alias("dia_orden"), "intensidad").orderBy(
        "hora", "dia_orden")


def yearly_evolution(trafico: DataFrame) -> DataFrame:
    return known_keys(trafico, "anio").groupBy("anio").agg(
        _even(F.avg("velocidad_kmh"), 1).alias("velocidad"), _even(F.avg("intensidad_veh_h"), 0).alias("intensidad"),
        _even(F.avg("indice_congestion") * 100, 1).alias("congestion"),
    ).orderBy("anio")


def monthly_seasonality(trafico: DataFrame) -> DataFrame:
    return known_keys(trafico, "mes", "anio", "mes_num").groupBy("mes", "anio", "mes_num").agg(
        F.avg("intensidad_veh_h").alias("intensidad"),
    ).select("mes", "anio", "mes_num", field_order(F.col("mes"), MONTHS).alias("mes_orden"), "intensidad").orderBy(
        "mes_num", "anio", "mes")


def zone_means(trafico: DataFrame) -> DataFrame:
    return known_keys(trafico, "corredor", "comuna").groupBy("corredor", "comuna").agg(
        F.avg("velocidad_kmh").alias("velocidad"), F.avg("intensidad_veh_h").alias("intensidad"),
        F.avg("ocupacion").alias("ocupacion"), stable(F.avg("indice_congestion")).alias("indice_congestion"))


def map_table(trafico: DataFrame, coordenadas: DataFrame) -> DataFrame:
    """Means of every located zone inside the city; missing figures shown as 0."""
    located = zone_means(trafico).join(coordenadas, ["corredor", "comuna"], "left")
    return inside_city(located).na.fill(0.0)


def _places(incidentes: DataFrame, *aggregates: Column) -> DataFrame:
    return known_keys(incidentes, "ubicacion").groupBy("ubicacion").agg(*aggregates).withColumn(
        "clave", match_key(F.col("ubicacion")))


def _total() -> Column:
    return F.count("id_incidente").alias("total")


def _vehicles() -> Column:
    return F.avg("conteo_vehicular").alias("vehiculos")


def incident_overlay(incidentes: DataFrame, coordenadas: DataFrame) -> DataFrame:
    """Located incident places with a marker size between 5 and 25, relative to the busiest of them."""
    places = _places(incidentes, F.count("id_incidente").alias("total_incidentes"))
    located = materialise(
        known_keys(places.join(one_point_per_corridor(coordenadas), "clave"), "latitud", "longitud"), "places")
    top = located.agg(F.max("total_incidentes").alias("m")).scalar()
    size = F.try_divide(F.col("total_incidentes"), top) * 20 + 5
    return located.select("ubicacion", "corredor", "total_incidentes", "latitud", "longitud",
                          size.alias("tamano")).orderBy("ubicacion", "corredor")


def corridor_headlines(map_rows: DataFrame) -> DataFrame:
    """One headline row per corridor: its first district by name."""
    fields = ("comuna", "velocidad", "intensidad", "ocupacion")
    return map_rows.groupBy("corredor").agg(F.min(F.struct(*fields)).alias("r")).select(
        "corredor", "r.velocidad", "r.intensidad", "r.ocupacion", "r.comuna")


def corridor_headline(map_rows: DataFrame, corridor: str) -> DataFrame:
    return corridor_headlines(map_rows.where(F.col("corredor") == corridor))


def corridor_hours(trafico: DataFrame, corridor: str) -> DataFrame:
    return known_keys(trafico.where(F.col("corredor") == corridor), "hora").groupBy("hora").agg(
        F.avg("velocidad_kmh").alias("velocidad_kmh"), F.avg("intensidad_veh_h").alias("intensidad_veh_h"),
    ).orderBy("hora")


def top_by_volume(trafico: DataFrame, n: int = 10) -> DataFrame:
    return named_corridors(trafico).groupBy("corredor").agg(
        # A corridor without any reading has volume 0, not a missing one.
        F.coalesce(F.sum("intensidad_veh_h"), F.lit(0.0)).alias("volumen_total"),
        F.avg("velocidad_kmh").alias("velocidad"),
    ).orderBy(F.desc("volumen_total"), "corredor").limit(n)


def incident_kpis(incidentes: DataFrame) -> DataFrame:
    return incidentes.agg(
        F.count("*").alias("total"), F.countDistinct("tipo_evento").alias("tipos"),
        F.count_if(F.col("gravedad") == SEVERITIES[0]).alias("criticos"),
        F.min("anio").alias("anio_min"), F.max("anio").alias("anio_max"))


def incident_types(incidentes: DataFrame) -> DataFrame:
    return known_keys(incidentes, "tipo_evento").groupBy("tipo_evento").agg(_total(), _vehicles()).orderBy("tipo_evento")


def incident_severities(incidentes: DataFrame) -> DataFrame:
    return known_keys(incidentes, "gravedad").groupBy("gravedad").agg(_total()).orderBy("gravedad")


def incidents_by_year_and_severity(incidentes: DataFrame) -> DataFrame:
    return known_keys(incidentes, "anio", "gravedad").groupBy("anio", "gravedad").agg(_total()).orderBy(
        "anio", "gravedad")


def top_incident_places(incidentes: DataFrame, n: int = 15) -> DataFrame:
    return known_keys(incidentes, "ubicacion").groupBy("ubicacion").agg(_total(), _vehicles()).orderBy(
        F.desc("total"), "ubicacion").limit(n)


def incident_map(incidentes: DataFrame, coordenadas: DataFrame) -> DataFrame:
    """Incident places with coordinates; places that cannot be located drop out."""
    places = _places(incidentes, _total(), _vehicles())
    joined = places.join(one_point_per_corridor(coordenadas), "clave")
    return known_keys(joined, "latitud", "longitud").select(
        "ubicacion", "total", "vehiculos", "corredor", "latitud", "longitud")


def traffic_vs_incidents(incidentes: DataFrame, map_rows: DataFrame) -> DataFrame:
    """Incidents next to the flow of the corridor of that exact name, one row per district of it."""
    places = known_keys(incidentes, "ubicacion").groupBy(F.col("ubicacion").alias("corredor")).agg(
        F.count("id_incidente").alias("total_incidentes"),
        F.avg("conteo_vehicular").alias("avg_vehiculos_afectados"))
    return places.join(map_rows.select("corredor", "intensidad", "velocidad"), "corredor")


def newest_readings(trafico: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    shown = ["fecha", "hora", "corredor", "velocidad_kmh", "intensidad_veh_h", "ocupacion", "periodo_dia"]
    return trafico.select(*shown).orderBy(
        F.desc_nulls_last("fecha"), *[F.desc_nulls_last(c) for c in shown[1:]]).limit(n)


def newest_incidents(incidentes: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    return incidentes.orderBy(F.desc_nulls_last("fecha_incidente"), "id").limit(n)
