"""Table schemas, raw column order and header spellings."""

from __future__ import annotations

from pyspark.sql import types as T

# The 25 raw columns in file order.
RAW_COLUMNS = (
    "carril", "fecha_trafico", "fecha", "hora", "dia_semana", "dia_num", "mes_num", "mes", "anio",
    "velocidad_kmh", "corredor", "sentido", "operacion", "intensidad_veh_h", "categoria_1", "categoria_2",
    "categoria_3", "categoria_4", "ocupacion", "tipo_subsistema", "longitud", "latitud", "identificador_fv",
    "comuna", "codigo_comuna",
)

_TYPES = {
    "fecha_trafico": T.TimestampNTZType(), "fecha": T.DateType(),
    **dict.fromkeys(("hora", "dia_num", "mes_num", "anio", "categoria_1", "categoria_2", "categoria_3",
                     "categoria_4"), T.IntegerType()),
    **dict.fromkeys(("velocidad_kmh", "intensidad_veh_h", "ocupacion", "longitud", "latitud", "codigo_comuna"),
                    T.DoubleType()),
}


def raw_schema(n: int = len(RAW_COLUMNS)) -> T.StructType:
    """The first ``n`` raw columns, all text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS[:n]])


TRAFFIC = T.StructType(
    [T.StructField(c, _TYPES.get(c, T.StringType())) for c in RAW_COLUMNS]
    + [
        T.StructField("periodo_dia", T.StringType()),
        T.StructField("es_hora_pico", T.BooleanType()),
        T.StructField("indice_congestion", T.DoubleType()),
    ]
)

INCIDENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("id_incidente", T.StringType()),
    T.StructField("fecha_incidente", T.TimestampNTZType()),
    T.StructField("ubicacion", T.StringType()),
    T.StructField("tipo_evento", T.StringType()),
    T.StructField("gravedad", T.StringType()),
    T.StructField("conteo_vehicular", T.IntegerType()),
    T.StructField("velocidad_promedio", T.DoubleType()),
    T.StructField("anio", T.IntegerType()),
])

COORDINATES = T.StructType([
    T.StructField("corredor", T.StringType()),
    T.StructField("comuna", T.StringType()),
    T.StructField("latitud", T.DoubleType()),
    T.StructField("longitud", T.DoubleType()),
])

CRITICAL_ZONES = T.StructType([
    T.StructField("corredor", T.StringType()),
    T.StructField("comuna", T.StringType()),
    T.StructField("total_registros", T.LongType()),
    T.StructField("velocidad_promedio", T.DoubleType()),
    T.StructField("intensidad_promedio", T.DoubleType()),
    T.StructField("ocupacion_promedio", T.DoubleType()),
])

# Header spellings of each column, wrongly decoded ones included.
HEADERS = {
    "carril": ("Carril",),
    "fecha_trafico": ("Fecha Trafico",),
    "fecha": ("Fecha",),
    "hora": ("Hora",),
    "dia_semana": ("dia",),
    "dia_num": ("dia-num",),
    "mes_num": ("mes-num",),
    "mes": ("mes",),
    "anio": ("a├▒o", "año"),
    "velocidad_kmh": ("Velocidad (Km/h)",),
    "corredor": ("Corredor",),
    "sentido": ("sentido",),
    "operacion": ("Operaci├│n", "Operación"),
    "intensidad_veh_h": ("Intensidad (Veh/h)", "Intensidad"),
    "categoria_1": ("Categoria 1 (Veh/h)", "N├║ vehiculos long 1", "N├â┬║ vehiculos long 1",
                    "N┬║ vehiculos long 1", "Nº vehiculos long 1"),
    "categoria_2": ("Categoria 2 (Veh/h)", "N├║ vehiculos long 2", "N├â┬║ vehiculos long 2",
                    "N┬║ vehiculos long 2", "Nº vehiculos long 2"),
    "categoria_3": ("Categoria 3 (Veh/h)", "N├║ vehiculos long 3", "N├â┬║ vehiculos long 3",
                    "N┬║ vehiculos long 3", "Nº vehiculos long 3"),
    "categoria_4": ("N├║ vehiculos long 4", "N├â┬║ vehiculos long 4",
                    "N┬║ vehiculos long 4", "Nº vehiculos long 4"),
    "ocupacion": ("Ocupaci├│n (%)", "Ocupación (%)", "Ocupaci├│n", "Ocupación", "Ocupacion"),
    "tipo_subsistema": ("Tipo de Subsistema",),
    "longitud": ("Longitud",),
    "latitud": ("Latitud",),
    "identificador_fv": ("Identificador (F/V)",),
    "comuna": ("Comuna",),
    "codigo_comuna": ("codigo comuna",),
}
