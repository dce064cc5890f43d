"""Traffic tables as views over the given tables; the same text runs in Spark and in the checker."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from calzada.functions.dates import MONTHS, WEEKDAYS
from calzada.operators.cleaning import clean
from calzada.operators.congestion import congestion_index
from calzada.operators.geo import corridor_coordinates
from calzada.sources.readers import drop_empty_rows, pieces_of, spread
from calzada.sources.catalog import conform_traffic
from calzada.sources.schemas import RAW_COLUMNS
from calzada.session import compile_in_parts, shuffles_of
from calzada.sources.workspace import new_folder
from calzada.sources.writers import write_parquet_by_year

JOINED = """FROM lineitem
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey"""

_WEEKDAY = ("CASE CAST(l_orderkey % 7 AS INT) "
            + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(WEEKDAYS)) + " END")
_MONTH = "CASE month(l_shipdate) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTHS, 1)) + " END"
_HOUR = "CAST((l_orderkey * 7 + l_linenumber * 5) % 24 AS INT)"

TRAFICO = f"""SELECT l_orderkey * 10 + l_linenumber AS id,
       concat('Carril ', CAST(l_linenumber AS VARCHAR(10))) AS carril,
       l_shipdate AS fecha_trafico,
       CAST(l_shipdate AS DATE) AS fecha,
       {_HOUR} AS hora,
       {_WEEKDAY} AS dia_semana,
       CAST(l_orderkey % 7 + 1 AS INT) AS dia_num,
       CAST(month(l_shipdate) AS INT) AS mes_num,
       {_MONTH} AS mes,
       CAST(year(l_shipdate) AS INT) AS anio,
       l_quantity * 2 AS velocidad_kmh,
       CASE WHEN p_partkey % 50 = 0 THEN 'Nan' WHEN p_partkey % 51 = 0 THEN NULL ELSE p_brand END AS corredor,
       l_linestatus AS sentido,
       lower(l_returnflag) AS operacion,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(floor(l_extendedprice / 50) AS INT) END AS intensidad_veh_h,
       CASE WHEN l_orderkey % 89 = 0 THEN NULL ELSE round(l_discount * 100, 0) END AS ocupacion,
       n_name AS comuna,
       CAST(n_nationkey AS DOUBLE) AS codigo_comuna
{JOINED}"""

INCIDENTES = """SELECT o_orderkey AS id,
       concat('INC-', CAST(o_orderkey AS VARCHAR(20))) AS id_incidente,
       o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS fecha_incidente,
       concat(CASE WHEN o_orderkey % 5 = 0 THEN ' brand#' ELSE 'Brand#' END, CAST(o_custkey % 30 + 1 AS VARCHAR(10))) AS ubicacion,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Accidente' WHEN '2-HIGH' THEN 'Congestion' WHEN '3-MEDIUM' THEN 'Obra'
            WHEN '4-NOT SPECIFIED' THEN 'Evento' ELSE 'Averia' END AS tipo_evento,
       CASE o_orderstatus WHEN 'F' THEN 'Crítico' WHEN 'O' THEN 'Moderado' ELSE 'Leve' END AS gravedad,
       CAST(floor(o_totalprice / 1000) AS INT) AS conteo_vehicular,
       CAST(o_custkey % 60 AS DOUBLE) AS velocidad_promedio,
       CAST(year(o_orderdate) AS INT) AS anio
FROM orders"""

COORDENADAS = """SELECT corredor, comuna,
       6.0 + CAST(length(corredor) AS DOUBLE) / 20 AS latitud,
       -75.8 + CAST(codigo_comuna AS DOUBLE) / 50 AS longitud
FROM (SELECT DISTINCT corredor, comuna, codigo_comuna FROM trafico WHERE corredor IS NOT NULL) x"""

# Raw cells as the sensor files hold them: text, with blanks, bad numbers, bad dates and gaps.
_RAW = {
    "carril": "concat('  carril ', CAST(l_linenumber AS VARCHAR(10)), ' ')",
    "fecha_trafico": f"""CASE WHEN l_orderkey % 83 = 0 THEN 'nope'
        ELSE concat(CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)), ' ', lpad(CAST({_HOUR} AS VARCHAR(2)), 2, '0'), ':30:00') END""",
    "fecha": "CASE WHEN l_orderkey % 79 = 0 THEN '2021-13-01' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) END",
    "hora": f"""CASE l_orderkey % 23 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '-3' WHEN 4 THEN '24'
        WHEN 5 THEN 'nan' ELSE concat(CAST({_HOUR} AS VARCHAR(2)), CASE WHEN l_orderkey % 2 = 0 THEN '.0' ELSE '.9' END) END""",
    "dia_semana": f"concat(' ', upper({_WEEKDAY}))",
    "dia_num": "CASE WHEN l_orderkey % 31 = 0 THEN 'x' ELSE CAST(l_orderkey % 7 + 1 AS VARCHAR(2)) END",
    "mes_num": "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(month(l_shipdate) AS VARCHAR(2)) END",
    "mes": f"""CASE WHEN l_orderkey % 37 = 0 THEN 'xx' WHEN l_orderkey % 3 = 0 THEN upper({_MONTH})
        WHEN l_orderkey % 3 = 1 THEN lower({_MONTH}) ELSE {_MONTH} END""",
    "anio": """CASE WHEN l_orderkey % 29 = 0 THEN NULL WHEN l_orderkey % 41 = 0 THEN 'dosmil'
        ELSE CAST(year(l_shipdate) AS VARCHAR(4)) END""",
    "velocidad_kmh": """CASE WHEN l_orderkey % 43 = 0 THEN 'nan' WHEN l_orderkey % 47 = 0 THEN 'abc'
        ELSE concat(' ', CAST(CAST(l_quantity * 2 AS INT) AS VARCHAR(10)), '.5 ') END""",
    "corredor": """CASE WHEN p_partkey % 51 = 0 THEN NULL WHEN p_partkey % 50 = 0 THEN ''
        WHEN p_partkey % 7 = 0 THEN concat(' ', lower(p_brand), '-ñandú 10a ') ELSE concat(upper(p_brand), '-regional ') END""",
    "sentido": "CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE concat(' ', lower(l_linestatus)) END",
    "operacion": "concat(upper(l_returnflag), ' ')",
    "intensidad_veh_h": "CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(CAST(floor(l_extendedprice / 50) AS INT) AS VARCHAR(12)) END",
    "categoria_1": "CAST(l_linenumber AS VARCHAR(10))",
    "categoria_2": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE concat(CAST(l_orderkey % 9 AS VARCHAR(5)), '.7') END",
    "categoria_3": "CASE WHEN l_orderkey % 2 = 0 THEN 'n/a' ELSE '3' END",
    "categoria_4": "CASE WHEN l_orderkey < 0 THEN '1' END",
    "ocupacion": """CASE WHEN l_orderkey % 89 = 0 THEN '' WHEN l_orderkey % 6007 = 0 THEN '5000' WHEN l_orderkey % 6011 = 0 THEN '-2'
        ELSE concat(CAST(CAST(round(l_discount * 100, 0) AS INT) AS VARCHAR(5)), '.25') END""",
    "tipo_subsistema": "CASE l_orderkey % 3 WHEN 0 THEN ' Arteria ' WHEN 1 THEN NULL ELSE 'Túnel' END",
    "longitud": """CASE n_nationkey % 4 WHEN 0 THEN CAST(815000 + p_partkey % 1000 * 45 AS VARCHAR(12)) WHEN 1 THEN '0'
        WHEN 2 THEN NULL ELSE '1500000' END""",
    "latitud": """CASE n_nationkey % 4 WHEN 0 THEN concat(CAST(1160000 + l_suppkey % 1000 * 45 AS VARCHAR(12)), '.5') WHEN 1 THEN '0'
        ELSE '1180000' END""",
    "identificador_fv": "CASE WHEN l_orderkey % 53 = 0 THEN 'V \"bis\", 2' WHEN l_orderkey % 2 = 0 THEN ' F ' ELSE 'V' END",
    "comuna": """CASE n_nationkey WHEN 1 THEN 'el poblado ' WHEN 2 THEN 'LA CANDELARIA' WHEN 3 THEN 'barrio belen sur'
        WHEN 5 THEN 'Santa Cruz' WHEN 6 THEN NULL WHEN 7 THEN '' WHEN 9 THEN 'Laureles - Estadio' WHEN 10 THEN 'None'
        WHEN 11 THEN 'candelaria norte' ELSE n_name END""",
    "codigo_comuna": "CAST(n_nationkey AS VARCHAR(5))",
}

# Every 101st order has nothing but gaps.
TRAFICO_RAW = ("SELECT " + ",\n       ".join(
    f"CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE {_RAW[c]} END AS {c}" for c in RAW_COLUMNS)
    + f",\n       CAST(year(l_shipdate) AS INT) AS anio_carpeta\n{JOINED}")

# Column types of the given tables; with them no job has to look into the files first.
SOURCE_TABLES = {
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,
                   l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,
                 o_orderpriority string""",
}

# Folder and schema of the tables stored so far, by application, data folder and table.
_stored: dict[tuple[str, str, str], tuple[str, StructType]] = {}


class Fixture:
    """The traffic tables of one data folder, built when first asked for.

    As in the data flow itself, the ETL's results (``indexed``, ``cleaned``) are stored by year once
    per application and data folder, and the queries read the stored tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        compile_in_parts(spark)
        for name, schema in SOURCE_TABLES.items():
            spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)

    def _keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored:
            path = self.folder(name)
            write_parquet_by_year(build(), path)
            _stored[key] = path, self.spark.read.parquet(path).schema
        path, schema = _stored[key]
        return self.spark.read.schema(schema).parquet(path)

    @cached_property
    def source(self) -> DataFrame:
        """Traffic as the view gives it, nothing stored."""
        return conform_traffic(self._over_spread_rows(TRAFICO))

    def _over_spread_rows(self, text: str) -> DataFrame:
        source = self.spark.table("lineitem")
        spread(source, "l_orderkey", "l_linenumber").createOrReplaceTempView("lineitem_repartida")
        # Where the joins shuffle, their pieces take the place of the source's, and widen just as much.
        shuffles_of(self.spark, pieces_of(source))
        return self.spark.sql(text.replace("FROM lineitem", "FROM lineitem_repartida"))

    @cached_property
    def indexed(self) -> DataFrame:
        """Traffic with the default congestion index."""
        return self._keep("trafico", lambda: congestion_index(self.source))

    @cached_property
    def trafico(self) -> DataFrame:
        return self.indexed.drop("indice_congestion")

    @cached_property
    def incidentes(self) -> DataFrame:
        return self.spark.sql(INCIDENTES)

    @cached_property
    def coordenadas(self) -> DataFrame:
        # Named frame, not a view: the text says "trafico" and must mean this one.
        return self.spark.sql(COORDENADAS.replace("FROM trafico", "FROM {trafico}"), trafico=self.trafico)

    @cached_property
    def raw(self) -> DataFrame:
        return self._over_spread_rows(TRAFICO_RAW)

    @cached_property
    def cleaned(self) -> DataFrame:
        return self._keep("limpio", lambda: clean(drop_empty_rows(self.raw)))

    @cached_property
    def located(self) -> DataFrame:
        return corridor_coordinates(self.cleaned)

    def folder(self, name: str) -> str:
        return new_folder(self.spark, name)
