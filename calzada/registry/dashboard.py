"""Entries D, N and E: dashboard tables, exploration tables, run summary."""

from __future__ import annotations

from calzada.operators.filters import filter_traffic
from calzada.plans import analytics, dashboard as d, etl, exploration as n, forecast
from calzada.registry.base import Entry
from calzada.registry.oracle import position
from calzada.functions.dates import MONTHS, WEEKDAYS

_NAMED = "corredor IS NOT NULL AND corredor NOT IN ('', 'Nan', 'None')"
_DAYS = ", ".join(f"'{x}'" for x in WEEKDAYS)
_CORRIDOR = "Brand#12"

_MAP = "SELECT corredor, comuna, velocidad, intensidad, ocupacion, indice_congestion, latitud, longitud FROM mapa"

_TRAFFIC_COLUMNS = ("id", "carril", "fecha_trafico", "fecha", "hora", "dia_semana", "dia_num", "mes_num", "mes", "anio", "velocidad_kmh",
                    "corredor", "sentido", "operacion", "intensidad_veh_h", "ocupacion", "comuna", "codigo_comuna", "periodo_dia",
                    "es_hora_pico", "indice_congestion")
_INCIDENT_COLUMNS = ("id", "id_incidente", "fecha_incidente", "ubicacion", "tipo_evento", "gravedad", "conteo_vehicular",
                     "velocidad_promedio", "anio")


def _nulls(table: str, columns, tail: str = "") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS columna, COUNT(*) - COUNT({c}) AS nulos, CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100 AS porcentaje FROM {table}"
        for c in columns)
    return f"SELECT columna, nulos, porcentaje FROM ({parts}) x {tail}"


_NUMERIC = ("id", "hora", "dia_num", "mes_num", "anio", "velocidad_kmh", "intensidad_veh_h", "ocupacion", "codigo_comuna")


def _describe(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS columna, COUNT({c}) AS count, ROUND(AVG(CAST({c} AS DOUBLE)), 6) AS mean, ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 6) AS std,
        MIN(CAST({c} AS DOUBLE)) AS min, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50,
        ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, MAX(CAST({c} AS DOUBLE)) AS max FROM {table}""" for c in columns)


_LABELS = """SELECT CAST(t AS INTEGER) AS t, last_day(CAST(make_date(anio_base, 1, 1) + to_months(CAST(t - 1 AS INTEGER)) AS DATE)) AS fecha,
    pendiente * t + ordenada AS y, anio_max FROM recta, generate_series(t_min, t_max + 48) s(t)"""

ENTRIES = {
    "d1_kpis": Entry(
        lambda f: d.kpis(f.indexed),
        # Figures of the whole from the sums of its years.
        """WITH anual AS (SELECT anio, COUNT(*) AS filas, SUM(velocidad_kmh) AS v, COUNT(velocidad_kmh) AS nv, SUM(intensidad_veh_h) AS i,
                                 COUNT(intensidad_veh_h) AS ni, SUM(indice_congestion) AS c, COUNT(indice_congestion) AS nc FROM indexado GROUP BY anio)
           SELECT CAST(SUM(filas) AS BIGINT) AS total_reg, ROUND(SUM(v) / SUM(nv), 1) AS vel_media, ROUND(SUM(i) / SUM(ni), 0) AS int_media,
                  ROUND(ROUND(100 * SUM(c) / SUM(nc), 9), 1) AS cong_media FROM anual"""),
    "d1_kpis_unrounded": Entry(
        lambda f: d.kpis(f.indexed, rounded=False),
        """SELECT COUNT(*) AS total_reg, AVG(velocidad_kmh) AS vel_media, AVG(intensidad_veh_h) AS int_media,
           ROUND(AVG(indice_congestion) * 100, 9) AS cong_media FROM indexado"""),
    "d2_year_options": Entry(lambda f: d.year_options(f.trafico), "SELECT DISTINCT anio FROM trafico ORDER BY anio"),
    "d2_corridor_options": Entry(
        lambda f: d.corridor_options(f.trafico),
        "SELECT DISTINCT corredor FROM trafico WHERE corredor <> '' AND corredor <> 'Nan' ORDER BY corredor"),
    "d3_hourly_profile": Entry(
        lambda f: d.hourly_profile(f.trafico),
        """WITH h AS (SELECT hora, AVG(velocidad_kmh) AS velocidad, AVG(intensidad_veh_h) AS intensidad FROM trafico GROUP BY hora)
           SELECT hora, velocidad, intensidad, intensidad / (SELECT MAX(intensidad) FROM h) * 60 AS intensidad_norm FROM h"""),
    "d4_congestion_by_corridor": Entry(
        lambda f: d.congestion_by_corridor(f.indexed),
        f"""WITH nombrados AS (SELECT * FROM indexado WHERE {_NAMED}),
           lentos AS (SELECT corredor, COUNT(*) AS congested FROM nombrados WHERE velocidad_kmh < 20 GROUP BY corredor),
           medidos AS (SELECT corredor, COUNT(velocidad_kmh) AS total, AVG(velocidad_kmh) AS vel_prom,
                              round_even(ROUND(AVG(indice_congestion) * 100, 9), 1) AS idx_cong FROM nombrados GROUP BY corredor),
           puestos AS (SELECT *, row_number() OVER (ORDER BY idx_cong DESC, corredor) AS puesto FROM medidos WHERE total > 100)
           SELECT corredor, total, COALESCE(congested, 0) AS congested, vel_prom, idx_cong FROM puestos LEFT JOIN lentos USING (corredor) WHERE puesto <= 15"""),
    "d5_hour_by_weekday": Entry(
        lambda f: d.hour_by_weekday(f.trafico),
        f"""SELECT hora, dia_semana, {position('dia_semana', WEEKDAYS)} AS dia_orden, AVG(intensidad_veh_h) AS intensidad
           FROM trafico WHERE dia_semana IN ({_DAYS}) GROUP BY hora, dia_semana"""),
    "d6_yearly_evolution": Entry(
        lambda f: d.yearly_evolution(f.indexed),
        """SELECT anio, round_even(ROUND(AVG(velocidad_kmh), 9), 1) AS velocidad, round_even(ROUND(AVG(intensidad_veh_h), 9), 0) AS intensidad,
           round_even(ROUND(AVG(indice_congestion) * 100, 9), 1) AS congestion FROM indexado GROUP BY anio"""),
    "d7_monthly_seasonality": Entry(
        lambda f: d.monthly_seasonality(f.trafico),
        f"""SELECT mes, anio, mes_num, {position('mes', MONTHS)} AS mes_orden, AVG(intensidad_veh_h) AS intensidad FROM trafico GROUP BY mes, anio, mes_num"""),
    "d8_forecast_fit": Entry(
        lambda f: forecast.trend(forecast.monthly_points(f.trafico)).selectExpr(
            "round(pendiente, 6) pendiente", "round(ordenada, 6) ordenada", "meses", "t_min", "t_max", "anio_base", "anio_max"),
        "SELECT ROUND(pendiente, 6) AS pendiente, ROUND(ordenada, 6) AS ordenada, meses, t_min, t_max, anio_base, anio_max FROM recta"),
    "d9_forecast_series": Entry(
        lambda f: forecast.projection(forecast.monthly_points(f.trafico)),
        f"""SELECT t, fecha, ROUND(y, 6) AS intensidad, CASE WHEN year(fecha) <= anio_max THEN 'Histórico' ELSE 'Pronóstico' END AS tipo
           FROM ({_LABELS}) x"""),
    "d10_monthly_points": Entry(
        lambda f: forecast.with_dates(forecast.monthly_points(f.trafico)),
        """SELECT anio, mes_num, intensidad, t, make_date(anio, CASE WHEN mes_num = 0 THEN 1 ELSE mes_num END, 1) AS fecha FROM meses
           WHERE intensidad IS NOT NULL"""),
    "d11_map_table": Entry(lambda f: d.map_table(f.indexed, f.coordenadas), _MAP),
    "d12_incident_overlay": Entry(
        lambda f: d.incident_overlay(f.incidentes, f.coordenadas),
        """WITH u AS (SELECT i.ubicacion, p.corredor, i.n AS total_incidentes, p.latitud, p.longitud
             FROM (SELECT ubicacion, lower(trim(ubicacion)) AS clave, COUNT(id_incidente) AS n FROM incidentes GROUP BY ubicacion) i JOIN puntos p ON i.clave = p.clave)
           SELECT *, CAST(total_incidentes AS DOUBLE) / (SELECT MAX(total_incidentes) FROM u) * 20 + 5 AS tamano FROM u"""),
    "d13_corridor_headlines": Entry(
        lambda f: d.corridor_headlines(d.map_table(f.indexed, f.coordenadas)),
        """SELECT corredor, velocidad, intensidad, ocupacion, comuna FROM (SELECT *, row_number() OVER (PARTITION BY corredor ORDER BY comuna) AS rn
           FROM mapa) x WHERE rn = 1"""),
    "d14_corridor_hours": Entry(
        lambda f: d.corridor_hours(f.trafico, _CORRIDOR),
        f"""SELECT hora, AVG(velocidad_kmh) AS velocidad_kmh, AVG(intensidad_veh_h) AS intensidad_veh_h FROM trafico
           WHERE corredor = '{_CORRIDOR}' GROUP BY hora"""),
    "d15_top_by_volume": Entry(
        lambda f: d.top_by_volume(f.trafico),
        f"""SELECT corredor, SUM(intensidad_veh_h) AS volumen_total, AVG(velocidad_kmh) AS velocidad FROM trafico WHERE {_NAMED}
           GROUP BY corredor ORDER BY volumen_total DESC, corredor LIMIT 10"""),
    "d16_incident_kpis": Entry(
        lambda f: d.incident_kpis(f.incidentes),
        """SELECT COUNT(*) AS total, COUNT(DISTINCT tipo_evento) AS tipos, COUNT(*) FILTER (WHERE gravedad = 'Crítico') AS criticos,
           MIN(anio) AS anio_min, MAX(anio) AS anio_max FROM incidentes"""),
    "d17_incident_types": Entry(
        lambda f: d.incident_types(f.incidentes),
        "SELECT tipo_evento, COUNT(id_incidente) AS total, AVG(conteo_vehicular) AS vehiculos FROM incidentes GROUP BY tipo_evento"),
    "d18_incident_severities": Entry(
        lambda f: d.incident_severities(f.incidentes),
        "SELECT gravedad, COUNT(id_incidente) AS total FROM incidentes GROUP BY gravedad"),
    "d19_incidents_by_year_and_severity": Entry(
        lambda f: d.incidents_by_year_and_severity(f.incidentes),
        "SELECT anio, gravedad, COUNT(id_incidente) AS total FROM incidentes GROUP BY anio, gravedad"),
    "d20_top_incident_places": Entry(
        lambda f: d.top_incident_places(f.incidentes),
        """SELECT ubicacion, COUNT(id_incidente) AS total, AVG(conteo_vehicular) AS vehiculos FROM incidentes GROUP BY ubicacion
           ORDER BY total DESC, ubicacion LIMIT 15"""),
    "d21_incident_map": Entry(
        lambda f: d.incident_map(f.incidentes, f.coordenadas),
        """SELECT ubicacion, total, vehiculos, p.corredor, p.latitud, p.longitud FROM (SELECT ubicacion, lower(trim(ubicacion)) AS clave,
           COUNT(id_incidente) AS total, AVG(conteo_vehicular) AS vehiculos FROM incidentes GROUP BY ubicacion) i JOIN puntos p ON i.clave = p.clave"""),
    "d22_traffic_vs_incidents": Entry(
        lambda f: d.traffic_vs_incidents(f.incidentes, d.map_table(f.indexed, f.coordenadas)),
        """SELECT i.corredor, total_incidentes, avg_vehiculos_afectados, m.intensidad, m.velocidad FROM (SELECT ubicacion AS corredor,
           COUNT(id_incidente) AS total_incidentes, AVG(conteo_vehicular) AS avg_vehiculos_afectados FROM incidentes GROUP BY ubicacion) i
           JOIN mapa m ON i.corredor = m.corredor"""),
    "d23_newest_readings": Entry(
        lambda f: d.newest_readings(f.trafico),
        """SELECT fecha, hora, corredor, velocidad_kmh, intensidad_veh_h, ocupacion, periodo_dia FROM trafico
           ORDER BY fecha DESC NULLS LAST, hora DESC NULLS LAST, corredor DESC NULLS LAST, velocidad_kmh DESC NULLS LAST,
           intensidad_veh_h DESC NULLS LAST, ocupacion DESC NULLS LAST, periodo_dia DESC NULLS LAST LIMIT 500"""),
    "d23_newest_incidents": Entry(
        lambda f: d.newest_incidents(f.incidentes),
        "SELECT * FROM incidentes ORDER BY fecha_incidente DESC NULLS LAST, id LIMIT 500"),
    "n1_preview": Entry(
        lambda f: n.preview(f.trafico.select("id", "fecha", "hora", "corredor", "velocidad_kmh"), order="id"),
        "SELECT id, fecha, hora, corredor, velocidad_kmh FROM trafico ORDER BY id LIMIT 3"),
    "n1_describe": Entry(lambda f: n.summary_statistics(f.trafico), _describe("trafico", _NUMERIC)),
    "n2_traffic_nulls": Entry(
        lambda f: n.traffic_nulls(f.indexed), _nulls("indexado", _TRAFFIC_COLUMNS, "ORDER BY nulos DESC, columna LIMIT 10")),
    "n2_incident_nulls": Entry(lambda f: n.incident_nulls(f.incidentes), _nulls("incidentes", _INCIDENT_COLUMNS)),
    "n3_yearly_evolution": Entry(
        lambda f: n.yearly_evolution(f.indexed),
        """SELECT anio, COUNT(velocidad_kmh) AS registros, round_even(ROUND(AVG(velocidad_kmh), 9), 1) AS velocidad_prom,
           round_even(ROUND(AVG(intensidad_veh_h), 9), 1) AS flujo_prom, round_even(ROUND(AVG(ocupacion), 9), 1) AS ocupacion_prom,
           round_even(ROUND(AVG(indice_congestion) * 100, 9), 1) AS congestion FROM indexado GROUP BY anio"""),
    "n4_hourly_means": Entry(
        lambda f: n.hourly_means(f.trafico),
        "SELECT hora, AVG(velocidad_kmh) AS velocidad, AVG(intensidad_veh_h) AS flujo FROM trafico GROUP BY hora"),
    "n5_weekday_means": Entry(
        lambda f: n.weekday_means(f.trafico),
        "SELECT dia_semana, AVG(intensidad_veh_h) AS flujo, AVG(velocidad_kmh) AS velocidad FROM trafico GROUP BY dia_semana"),
    **{
        name: Entry(
            lambda f, least=least: n.top_congested(f.indexed, least),
            f"""SELECT corredor, AVG(velocidad_kmh) AS velocidad, ROUND(AVG(indice_congestion) * 100, 9) AS congestion,
               COUNT(velocidad_kmh) AS registros FROM indexado WHERE {_NAMED} GROUP BY corredor HAVING registros > {least}
               ORDER BY congestion DESC, corredor LIMIT 10""")
        # No corridor of the small data sets has 10,000 readings, hence the second threshold.
        for name, least in (("n6_top_congested", 10_000), ("n6_top_congested_over_1000", 1_000))
    },
    "n7_top_volume": Entry(
        lambda f: n.top_volume(f.trafico),
        f"""SELECT corredor, SUM(intensidad_veh_h) AS volumen, AVG(velocidad_kmh) AS velocidad FROM trafico WHERE {_NAMED}
           GROUP BY corredor ORDER BY volumen DESC, corredor LIMIT 10"""),
    "n8_type_counts": Entry(
        lambda f: n.incident_type_counts(f.incidentes), "SELECT tipo_evento, COUNT(*) AS total FROM incidentes GROUP BY tipo_evento"),
    "n8_severity_counts": Entry(
        lambda f: n.incident_severity_counts(f.incidentes), "SELECT gravedad, COUNT(*) AS total FROM incidentes GROUP BY gravedad"),
    "e1_run_summary": Entry(
        lambda f: etl.run_summary(f.trafico),
        """SELECT COUNT(*) AS registros, COUNT(DISTINCT anio) AS anios, COUNT(DISTINCT corredor) AS corredores FROM trafico"""),
    "e1_corridor_list": Entry(
        lambda f: etl.corridor_list(f.trafico), "SELECT DISTINCT corredor FROM trafico WHERE corredor IS NOT NULL"),
    "p1_filtered_yearly_evolution": Entry(
        lambda f: d.yearly_evolution(filter_traffic(f.indexed, years=(1996, 1999), corridors=("Brand#12", "Brand#33"), period="Tarde")),
        """SELECT anio, round_even(ROUND(AVG(velocidad_kmh), 9), 1) AS velocidad, round_even(ROUND(AVG(intensidad_veh_h), 9), 0) AS intensidad,
           round_even(ROUND(AVG(indice_congestion) * 100, 9), 1) AS congestion FROM indexado
           WHERE anio IN (1996, 1999) AND corredor IN ('Brand#12', 'Brand#33') AND periodo_dia = 'Tarde' GROUP BY anio"""),
    "p9_map_by_period": Entry(
        lambda f: d.zone_means(filter_traffic(f.indexed, period="Noche")),
        """SELECT corredor, comuna, AVG(velocidad_kmh) AS velocidad, AVG(intensidad_veh_h) AS intensidad, AVG(ocupacion) AS ocupacion,
           ROUND(AVG(indice_congestion), 9) AS indice_congestion FROM indexado WHERE periodo_dia = 'Noche' AND corredor IS NOT NULL
           AND comuna IS NOT NULL GROUP BY corredor, comuna"""),
    "s14_critical_zones_table": Entry(
        lambda f: _critical_table(f),
        """SELECT corredor, comuna, COUNT(*) AS total_registros, AVG(velocidad_kmh) AS velocidad_promedio,
           AVG(intensidad_veh_h) AS intensidad_promedio, AVG(ocupacion) AS ocupacion_promedio FROM trafico GROUP BY corredor, comuna"""),
}


def _critical_table(f):
    from calzada.sources.writers import reload_table

    path = f.folder("zonas_criticas")
    reload_table(analytics.critical_zones(f.trafico), path)
    return f.spark.read.parquet(path)
