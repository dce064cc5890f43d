"""Registers the tables the queries work on, from whichever source there is."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from calzada.functions import traffic as tr
from calzada.operators.congestion import repair_index
from calzada.sources.schemas import COORDINATES, INCIDENTS, TRAFFIC


@dataclass(frozen=True)
class Tables:
    trafico: DataFrame
    incidentes: DataFrame
    coordenadas: DataFrame


TABLE_NAMES = ("trafico", "incidentes", "coordenadas")


def conform_traffic(df: DataFrame) -> DataFrame:
    """Measures as doubles and the derived columns a table may lack."""
    out = df.withColumns({c: df[c].cast("double") for c in ("velocidad_kmh", "intensidad_veh_h", "ocupacion")})
    derived = {"periodo_dia": tr.day_period(df["hora"]), "es_hora_pico": tr.rush_hour(df["hora"])}
    return out.withColumns({k: v for k, v in derived.items() if k not in df.columns})


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the declared types; undeclared ones stay as they are, and declared ones that are missing are not made up."""
    return df.withColumns({f.name: df[f.name].cast(f.dataType) for f in schema if f.name in df.columns and df.schema[f.name].dataType != f.dataType})


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def open_tables(spark: SparkSession, parquet: Mapping[str, str] | None = None,
                loaders: Mapping[str, Callable[[], DataFrame]] | None = None, repair: bool = True) -> Tables:
    """Tables by name: a Parquet path that exists first, a loader (SQL, JDBC) where there is none.

    They have the declared column types. An index of traffic that adds up to 0 although there is occupancy is worked out anew.
    """
    parquet, loaders = parquet or {}, loaders or {}
    found = {}
    for name, schema in zip(TABLE_NAMES, (TRAFFIC, INCIDENTS, COORDINATES)):
        if name in parquet and _there(spark, parquet[name]):
            found[name] = conform(spark.read.parquet(parquet[name]), schema)
        elif name in loaders:
            found[name] = conform(loaders[name](), schema)
        else:
            raise KeyError(f"no source for table {name}")
    trafico = conform_traffic(found["trafico"])
    if repair and {"indice_congestion", "ocupacion"} <= set(trafico.columns):
        trafico = repair_index(trafico)
    return Tables(**{**found, "trafico": trafico})


def register_views(tables: Tables, prefix: str = "") -> None:
    for name in TABLE_NAMES:
        getattr(tables, name).createOrReplaceTempView(prefix + name)
