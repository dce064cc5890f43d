"""Building blocks of the checking SQL: the fixture views and independent forms of the operators."""

from __future__ import annotations

import re

from calzada.operators.geo import DISTRICT_POINTS
from calzada.registry.fixture import COORDENADAS, INCIDENTES, TRAFICO, TRAFICO_RAW
from calzada.sources.schemas import RAW_COLUMNS

MONTHS_LOWER = ("['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre',"
                "'noviembre','diciembre']")


def period(h: str) -> str:
    return (f"CASE WHEN {h} BETWEEN 0 AND 5 THEN 'Madrugada' WHEN {h} BETWEEN 6 AND 11 THEN 'Mañana' "
            f"WHEN {h} BETWEEN 12 AND 17 THEN 'Tarde' WHEN {h} BETWEEN 18 AND 23 THEN 'Noche' END")


def rush(h: str) -> str:
    return f"({h} BETWEEN 6 AND 9 OR {h} BETWEEN 17 AND 20)"


def num(c: str) -> str:
    return (rf"CASE WHEN regexp_full_match(trim({c}), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') "
            f"THEN TRY_CAST(trim({c}) AS DOUBLE) END")


def whole(c: str, default: str = "0") -> str:
    return f"COALESCE(CAST(trunc({num(c)}) AS INTEGER), {default})"


def title(c: str) -> str:
    return (rf"array_to_string(list_transform(regexp_extract_all(lower({c}), '(\p{{L}}+|[^\p{{L}}]+)'), "
            "lambda t: upper(t[1]) || t[2:]), '')")


def month_no(c: str) -> str:
    return f"CAST(COALESCE(list_position({MONTHS_LOWER}, lower(trim({c}))), 0) AS INTEGER)"


def position(c: str, values: tuple[str, ...]) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"CAST(COALESCE(list_position([{items}], {c}), 0) AS INTEGER)"


_EMPTY = " AND ".join(f"{c} IS NULL" for c in RAW_COLUMNS)

_TYPED = {
    **{c: num(c) for c in ("velocidad_kmh", "intensidad_veh_h", "ocupacion", "codigo_comuna", "longitud", "latitud")},
    **{c: whole(c) for c in ("categoria_1", "categoria_2", "categoria_3", "categoria_4", "hora", "dia_num")},
    **{c: title(f"trim({c})") for c in ("carril", "corredor", "comuna", "dia_semana", "mes")},
    "mes_num": whole("mes_num", month_no("mes")),
    "anio": whole("anio", "anio_carpeta"),
    "fecha_trafico": "TRY_CAST(fecha_trafico AS TIMESTAMP)",
    "fecha": "TRY_CAST(fecha AS DATE)",
    "sentido": "upper(trim(sentido))",
    "operacion": "lower(trim(operacion))",
    "tipo_subsistema": "trim(tipo_subsistema)",
    "identificador_fv": "trim(identificador_fv)",
}

# Snyder's footpoint series (USGS Professional Paper 1395), unlike the library's own.
_A, _F = 6378137.0, 1 / 298.257222101
_E2 = 2 * _F - _F * _F
_EP2 = _E2 / (1 - _E2)
_E1 = (1 - (1 - _E2) ** 0.5) / (1 + (1 - _E2) ** 0.5)
_MU = _A * (1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256)


def _arc(phi: str) -> str:
    """Meridian arc from the equator."""
    return (f"{_A!r} * ({1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256!r} * {phi} "
            f"- {3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024!r} * sin(2 * {phi}) "
            f"+ {15 * _E2**2 / 256 + 45 * _E2**3 / 1024!r} * sin(4 * {phi}) - {35 * _E2**3 / 3072!r} * sin(6 * {phi}))")


_PHI0 = "radians(4.59620041666667::DOUBLE)"

# Every table the checks may name; a check carries only the ones it needs.
TABLES = {
    "trafico_base": TRAFICO,
    "trafico": f"""SELECT * REPLACE (CAST(velocidad_kmh AS DOUBLE) AS velocidad_kmh, CAST(intensidad_veh_h AS DOUBLE) AS intensidad_veh_h,
        CAST(ocupacion AS DOUBLE) AS ocupacion), {period('hora')} AS periodo_dia, {rush('hora')} AS es_hora_pico FROM trafico_base""",
    "incidentes": INCIDENTES,
    "coordenadas": COORDENADAS,
    "p95": "SELECT anio, quantile_cont(ocupacion, 0.95) AS p95 FROM trafico GROUP BY anio",
    "indexado": """SELECT t.*, CASE WHEN COALESCE(p95, 0) > 0 THEN CASE WHEN ocupacion IS NULL THEN NULL
        ELSE greatest(0.0, least(1.0, ocupacion / p95)) END ELSE 0.0 END AS indice_congestion FROM trafico t LEFT JOIN p95 USING (anio)""",
    "trafico_raw": TRAFICO_RAW,
    # What comes back from CSV: a blank cell is a missing one.
    "leido": "SELECT " + ", ".join(f"NULLIF({c}, '') AS {c}" for c in RAW_COLUMNS) + ", anio_carpeta FROM trafico_raw",
    "crudo": f"SELECT * FROM trafico_raw WHERE NOT ({_EMPTY})",
    "tipado": "SELECT " + ", ".join(f"{_TYPED[c]} AS {c}" for c in RAW_COLUMNS) + " FROM crudo",
    "limpio": f"SELECT *, {period('hora')} AS periodo_dia, {rush('hora')} AS es_hora_pico FROM tipado",
    "p95_limpio": "SELECT anio, quantile_cont(ocupacion, 0.95) AS p95 FROM limpio GROUP BY anio",
    "pares": """SELECT corredor, comuna, latitud, longitud FROM (SELECT corredor, comuna, latitud, longitud,
        row_number() OVER (PARTITION BY corredor, comuna ORDER BY latitud NULLS LAST, longitud NULLS LAST) AS rn FROM limpio) x WHERE rn = 1""",
    "huella": f"""SELECT *, (latitud - 1000000.0 + {_arc(_PHI0)}) / {_MU!r} AS mu, longitud - 1000000.0 AS x FROM pares""",
    "pie": f"""SELECT *, mu + {3 * _E1 / 2 - 27 * _E1**3 / 32!r} * sin(2 * mu) + {21 * _E1**2 / 16 - 55 * _E1**4 / 32!r} * sin(4 * mu)
        + {151 * _E1**3 / 96!r} * sin(6 * mu) + {1097 * _E1**4 / 512!r} * sin(8 * mu) AS f FROM huella""",
    "radios": f"""SELECT *, {_EP2!r} * cos(f) * cos(f) AS c, tan(f) * tan(f) AS t, {_A!r} / sqrt(1 - {_E2!r} * sin(f) * sin(f)) AS n,
        {_A * (1 - _E2)!r} / pow(1 - {_E2!r} * sin(f) * sin(f), 1.5) AS r FROM pie""",
    "grados": f"""SELECT corredor, comuna, latitud AS norte, longitud AS este,
        degrees(f - (n * tan(f) / r) * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {_EP2!r}) * pow(d, 4) / 24
          + (61 + 90 * t + 298 * c + 45 * t * t - 252 * {_EP2!r} - 3 * c * c) * pow(d, 6) / 720)) AS la,
        -74.0775079166667::DOUBLE + degrees((d - (1 + 2 * t + c) * pow(d, 3) / 6
          + (5 - 2 * c + 28 * t - 3 * c * c + 8 * {_EP2!r} + 24 * t * t) * pow(d, 5) / 120) / cos(f)) AS lo
        FROM (SELECT *, x / n AS d FROM radios) y""",
    "convertido": """SELECT corredor, comuna, CASE WHEN ok THEN round(la, 6) END AS latitud, CASE WHEN ok THEN round(lo, 6) END AS longitud
        FROM (SELECT *, norte <> 0 AND este <> 0 AND la BETWEEN 6.0 AND 6.5 AND lo BETWEEN -75.8 AND -75.3 AS ok FROM grados) z""",
    "barrios": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{name.lower()}', {lat}::DOUBLE, {lon}::DOUBLE)" for i, (name, lat, lon) in enumerate(DISTRICT_POINTS)) + ") b(i, clave, blat, blon)",
    "por_barrio": """SELECT c.corredor, c.comuna, COALESCE(c.latitud, b.blat) AS latitud, COALESCE(c.longitud, b.blon) AS longitud
        FROM convertido c LEFT JOIN barrios b ON b.i = (SELECT min(k.i) FROM barrios k
          WHERE c.comuna NOT IN ('', 'None') AND contains(lower(c.comuna), k.clave))""",
    "medias": "SELECT corredor, avg(latitud) AS mla, avg(longitud) AS mlo FROM por_barrio WHERE latitud IS NOT NULL GROUP BY corredor",
    "ubicado": """SELECT p.corredor, p.comuna, COALESCE(latitud, mla, 6.245) AS latitud, COALESCE(longitud, mlo, -75.581) AS longitud
        FROM por_barrio p LEFT JOIN medias m ON p.corredor = m.corredor""",
    "puntos": """SELECT lower(trim(corredor)) AS clave, corredor, latitud, longitud FROM (SELECT *,
        row_number() OVER (PARTITION BY corredor ORDER BY comuna) AS rn FROM coordenadas) x WHERE rn = 1""",
    "mapa": """SELECT z.corredor, z.comuna, COALESCE(velocidad, 0) AS velocidad, COALESCE(intensidad, 0) AS intensidad,
        COALESCE(ocupacion, 0) AS ocupacion, COALESCE(indice_congestion, 0) AS indice_congestion, latitud, longitud
        FROM (SELECT corredor, comuna, AVG(velocidad_kmh) AS velocidad, AVG(intensidad_veh_h) AS intensidad, AVG(ocupacion) AS ocupacion,
          round(AVG(indice_congestion), 9) AS indice_congestion FROM indexado WHERE corredor IS NOT NULL AND comuna IS NOT NULL GROUP BY ALL) z
        JOIN coordenadas c ON z.corredor = c.corredor AND z.comuna = c.comuna
        WHERE latitud BETWEEN 6.0 AND 6.5 AND longitud BETWEEN -75.8 AND -75.3""",
    "meses": """SELECT anio, mes_num, AVG(intensidad_veh_h) AS intensidad, (anio - min(anio) OVER ()) * 12 + mes_num AS t
        FROM trafico WHERE anio IS NOT NULL AND mes_num IS NOT NULL GROUP BY anio, mes_num""",
    "recta": """SELECT COALESCE(regr_slope(intensidad, t), 0) AS pendiente, COALESCE(regr_intercept(intensidad, t), 0) AS ordenada,
        count(*) AS meses, min(t) AS t_min, max(t) AS t_max, min(anio) AS anio_base, max(anio) AS anio_max
        FROM meses WHERE intensidad IS NOT NULL""",
}

_NAME = re.compile(r"\b(" + "|".join(TABLES) + r")\b")


def with_tables(sql: str) -> str:
    """The statement behind the definitions it needs, in order of definition."""
    needed, todo = set(), [sql]
    while todo:
        for name in set(_NAME.findall(re.sub(r"\bAS \w+", "", todo.pop()))) - needed:
            needed.add(name)
            todo.append(TABLES[name])
    if sql.lstrip().startswith("WITH"):
        sql = f"SELECT * FROM ({sql}) q"
    parts = [f"{name} AS (\n{TABLES[name]}\n)" for name in TABLES if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
