"""Entries Q: the analytic SQL set.

The checks are written for DuckDB in their own form: filtered aggregates, joined one-row aggregates,
``QUALIFY``.
"""

from __future__ import annotations

from calzada.plans import analytics as q
from calzada.registry.base import Entry
from calzada.registry.fixture import Fixture
from calzada.registry.oracle import period


def _mean(column: str, digits: int, name: str) -> str:
    return f"round(avg({column}), {digits}) AS {name}"


def _grouped(table: str, keys: str, *aggregates: str, tail: str = "") -> str:
    return f"SELECT {keys}, {', '.join(aggregates)} FROM {table} GROUP BY ALL {tail}"


_SEVERITIES = ", ".join(f"count(*) FILTER (gravedad = '{g}') AS {name}"
                        for g, name in (("Crítico", "criticos"), ("Moderado", "moderados"), ("Leve", "leves")))
_SPEED = _mean("velocidad_kmh", 1, "velocidad_promedio")
_VEHICLES = _mean("conteo_vehicular", 0, "avg_vehiculos_afectados")
_VOLUME = "sum(intensidad_veh_h) AS total_vehiculos"
_SLOW = "count(*) FILTER (velocidad_kmh < 30)"


def _view(name: str):
    def run(f: Fixture):
        q.create_views(f.spark, f.trafico, f.incidentes)
        return f.spark.table(name)
    return run


ENTRIES = {
    "q1_yearly_summary": Entry(
        lambda f: q.yearly_summary(f.trafico),
        _grouped("trafico", "anio", "count(*) AS total_registros", _SPEED, _VOLUME,
                 _mean("intensidad_veh_h", 0, "promedio_vehiculos_por_hora"))),
    "q2_incidents_by_type": Entry(
        lambda f: q.incidents_by_type(f.incidentes),
        _grouped("incidentes", "tipo_evento", "count(*) AS total", _VEHICLES, _mean("velocidad_promedio", 1, "avg_velocidad"))),
    "q3_incidents_by_severity": Entry(
        lambda f: q.incidents_by_severity(f.incidentes), _grouped("incidentes", "gravedad", "count(*) AS total", _VEHICLES)),
    "q4_congestion_by_zone": Entry(
        lambda f: q.congestion_by_zone(f.trafico),
        _grouped("trafico", "comuna, corredor", "count(*) AS total_registros", f"{_SLOW} AS registros_congestion",
                 f"round(CAST({_SLOW} AS DOUBLE) * 100 / count(*), 1) AS indice_congestion_pct",
                 _mean("velocidad_kmh", 1, "velocidad_promedio_kmh"))),
    "q5_speed_by_hour": Entry(
        lambda f: q.speed_by_hour(f.trafico), _grouped("trafico", "hora", _SPEED, _VOLUME, "count(*) AS registros")),
    "q6_volume_by_weekday": Entry(
        lambda f: q.volume_by_weekday(f.trafico),
        _grouped("trafico", "dia_semana", _VOLUME, _mean("intensidad_veh_h", 0, "promedio_diario"), _SPEED)),
    "q7_peak_hours": Entry(
        lambda f: q.peak_hours(f.trafico),
        _grouped("trafico", "periodo_dia, hora", _SPEED, _mean("intensidad_veh_h", 0, "avg_vehiculos"), "count(*) AS registros",
                 tail="ORDER BY avg_vehiculos DESC, hora LIMIT 10")),
    "q8_incidents_by_period": Entry(
        lambda f: q.incidents_by_period(f.incidentes),
        _grouped("incidentes", f"coalesce({period('hour(fecha_incidente)')}, 'Noche') AS periodo, gravedad",
                 "count(*) AS total_incidentes")),
    "q9_top_incident_zones": Entry(
        lambda f: q.top_incident_zones(f.incidentes),
        _grouped("incidentes", "ubicacion", "count(*) AS total_incidentes", _VEHICLES,
                 "round(avg(incidentes.velocidad_promedio), 1) AS velocidad_promedio",
                 tail="ORDER BY total_incidentes DESC, ubicacion LIMIT 15")),
    "q10_incidents_by_month": Entry(
        lambda f: q.incidents_by_month(f.incidentes),
        _grouped("incidentes", "CAST(month(fecha_incidente) AS INTEGER) AS mes", "count(*) AS total_incidentes", _SEVERITIES)),
    "q11_traffic_and_incidents": Entry(
        lambda f: q.traffic_and_incidents(f.trafico, f.incidentes),
        # Joining every reading to every incident makes billions of rows at larger sizes; zones meet incidents here.
        f"""SELECT z.*, count(DISTINCT i.id) AS total_incidentes, {_mean("i.conteo_vehicular", 0, "vehiculos_afectados_incidentes")}
            FROM ({_grouped("trafico", "comuna, corredor", _mean("velocidad_kmh", 1, "velocidad_trafico"),
                            _mean("intensidad_veh_h", 0, "volumen_trafico"))}) z
            LEFT JOIN incidentes i ON i.ubicacion = z.corredor GROUP BY ALL"""),
    "q12_slower_than_average": Entry(
        lambda f: q.slower_than_average(f.trafico),
        f"""SELECT corredor, comuna, round(v, 1) AS velocidad_promedio, volumen_promedio FROM
            ({_grouped("trafico", "corredor, comuna", "avg(velocidad_kmh) AS v", _mean("intensidad_veh_h", 0, "volumen_promedio"))}) z,
            (SELECT avg(velocidad_kmh) AS todas FROM trafico) a WHERE v < todas"""),
    "q12b_busiest_days": Entry(
        lambda f: q.busiest_days(f.trafico),
        f"""SELECT * FROM ({_grouped("trafico", "comuna, fecha", "sum(intensidad_veh_h) AS volumen_diario")}) d
            QUALIFY row_number() OVER (PARTITION BY comuna ORDER BY volumen_diario DESC NULLS LAST, fecha) <= 3"""),
    "q13_view_daily_summary": Entry(
        _view("vw_resumen_diario"),
        _grouped("trafico", "fecha, anio, mes, dia_semana", _VOLUME, _SPEED,
                 f"round(CAST({_SLOW} AS DOUBLE) / count(*) * 100, 1) AS pct_congestion")),
    "q14_view_incidents_by_zone": Entry(
        _view("vw_incidentes_por_zona"),
        _grouped("incidentes", "ubicacion", "count(*) AS total_incidentes", _SEVERITIES, _VEHICLES)),
    "q15_view_general_kpis": Entry(
        _view("vw_kpi_generales"),
        f"""SELECT * FROM (SELECT count(*) AS total_registros_trafico, {_mean("velocidad_kmh", 1, "velocidad_promedio_general")},
              sum(intensidad_veh_h) AS volumen_vehicular_total FROM trafico) t,
            (SELECT count(*) AS total_incidentes, {_mean("conteo_vehicular", 0, "avg_vehiculos_afectados_incidentes")} FROM incidentes) i"""),
    "q16_critical_zones": Entry(
        lambda f: q.critical_zones(f.trafico),
        _grouped("trafico", "corredor, comuna", "count(*) AS total_registros",
                 *[f"avg({c}) AS {n}_promedio" for c, n in (("velocidad_kmh", "velocidad"), ("intensidad_veh_h", "intensidad"),
                                                            ("ocupacion", "ocupacion"))])),
    "q17_overall_means": Entry(
        lambda f: q.overall_means(f.trafico),
        "SELECT avg(velocidad_kmh) AS velocidad_media, avg(intensidad_veh_h) AS intensidad_media, avg(ocupacion) AS ocupacion_media FROM trafico"),
}
