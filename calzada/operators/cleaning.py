"""From raw text columns to the typed traffic table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calzada.functions import dates, numbers, text
from calzada.functions import traffic as tr
from calzada.sources.schemas import RAW_COLUMNS

MEASURES = ("velocidad_kmh", "intensidad_veh_h", "ocupacion", "codigo_comuna", "longitud", "latitud")
VEHICLE_CLASSES = ("categoria_1", "categoria_2", "categoria_3", "categoria_4")
TITLED = ("carril", "corredor", "comuna", "dia_semana", "mes")


def clean_for_csv(df: DataFrame, folder_year: str = "anio_carpeta") -> DataFrame:
    """Row-mode cleaning: everything stays text but hour, month number and year."""
    out = {c: text.clean_cell(F.col(c)) for c in RAW_COLUMNS}
    out["hora"] = numbers.to_int(F.col("hora"))
    out["mes_num"] = dates.month_number(F.col("mes"))
    out["anio"] = F.col(folder_year).cast("int")
    out["corredor"] = text.title_case(out["corredor"])
    out["sentido"] = F.upper(out["sentido"])
    out["operacion"] = F.lower(out["operacion"])
    return df.select(*[out[c].alias(c) for c in RAW_COLUMNS])


def typed_columns(folder_year: Column, null_text: str = "null", layouts: Sequence[str] = ()) -> dict[str, Column]:
    """Typed expression of every raw column."""
    c = {name: F.col(name) for name in RAW_COLUMNS}
    out = {name: numbers.to_number(c[name]) for name in MEASURES}
    out |= {name: numbers.to_int(c[name]) for name in VEHICLE_CLASSES}
    out |= {name: text.normal_title(c[name], null_text) for name in TITLED}
    out |= {
        "hora": numbers.to_int(c["hora"]),
        "dia_num": numbers.to_int(c["dia_num"]),
        # The month column where it holds a number, else the month's name.
        "mes_num": F.coalesce(numbers.to_int(c["mes_num"], None), dates.month_number(c["mes"])),
        "anio": numbers.to_int(c["anio"], folder_year),
        "fecha_trafico": dates.to_timestamp(c["fecha_trafico"], layouts),
        "fecha": dates.to_date(c["fecha"], layouts),
        "sentido": text.normal_upper(c["sentido"], null_text),
        "operacion": text.normal_lower(c["operacion"], null_text),
        "tipo_subsistema": text.normal_plain(c["tipo_subsistema"], null_text),
        # The Parquet form leaves this one as it is, blanks and gaps included.
        "identificador_fv": c["identificador_fv"] if null_text == "pandas" else text.normal_plain(c["identificador_fv"], null_text),
    }
    return out


def with_derived(df: DataFrame, null_text: str = "null") -> DataFrame:
    """Day period and rush-hour flag. An hour without a period has none, or the text ``nan`` in the two forms that hold text."""
    period = tr.day_period(F.col("hora"))
    if null_text != "null":
        period = F.coalesce(period, F.lit("nan"))
    return df.withColumns({"periodo_dia": period, "es_hora_pico": tr.rush_hour(F.col("hora"))})


def clean(df: DataFrame, folder_year: str = "anio_carpeta", null_text: str = "null",
          keep: Sequence[str] = (), layouts: Sequence[str] = ()) -> DataFrame:
    """Typed table with the derived columns, index excepted. One projection, no shuffle.

    ``layouts`` are patterns for dates that are not ISO, tried in order.
    """
    typed = typed_columns(F.col(folder_year).cast("int"), null_text, layouts)
    return with_derived(df.select(*[typed[c].alias(c) for c in RAW_COLUMNS], *keep), null_text)


def clean_incidents(df: DataFrame) -> DataFrame:
    """Typed incidents: bad date or speed becomes NULL, a bad count 0."""
    return df.withColumns({
        "fecha_incidente": dates.to_timestamp(F.col("fecha_incidente").cast("string")),
        "conteo_vehicular": numbers.to_int(F.col("conteo_vehicular")),
        "velocidad_promedio": numbers.to_number(F.col("velocidad_promedio")),
    })


NARROW = {"hora": "tinyint", "dia_num": "tinyint", "mes_num": "tinyint", "anio": "smallint"}


def narrow_types(df: DataFrame, integers: dict[str, str] | None = None) -> DataFrame:
    """Doubles as floats, small integers in the types given.

    By default those are the usual ones, or wider where a value needs it, which is measured first.
    """
    if integers is None:
        order = ("tinyint", "smallint", "int", "bigint")
        needed = smallest_integers(df.select(*[c for c in NARROW if c in df.columns]))
        integers = {c: max(t, needed.get(c, t), key=order.index) for c, t in NARROW.items()}
    casts = {f.name: F.col(f.name).cast("float") for f in df.schema if f.dataType.simpleString() == "double"}
    casts |= {c: F.col(c).cast(t) for c, t in integers.items() if c in df.columns}
    return df.withColumns(casts)


def smallest_integers(df: DataFrame) -> dict[str, str]:
    """Smallest type that holds each integer column, measured in one pass over the data."""
    wide = [f.name for f in df.schema if f.dataType.simpleString() in ("int", "bigint")]
    if not wide:
        return {}
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in wide], *[F.max(c).alias(f"hi_{c}") for c in wide]).first()
    out = {}
    for c in wide:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        for name, bits in (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64)):
            if lo is None or (-(2 ** (bits - 1)) <= lo and hi < 2 ** (bits - 1)):
                out[c] = name
                break
    return out
