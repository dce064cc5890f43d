"""Filters of the dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calzada.functions.numbers import finite
from calzada.functions.traffic import named

ALL_PERIODS = "Todos"


def filter_traffic(df: DataFrame, years: Sequence[int] = (), corridors: Sequence[str] = (),
                   period: str = ALL_PERIODS) -> DataFrame:
    """Rows of the chosen years, corridors and day period; an empty choice does not filter."""
    if years:
        df = df.where(F.col("anio").isin(*[int(y) for y in years]))
    if corridors:
        df = df.where(F.col("corredor").isin(*corridors))
    if period != ALL_PERIODS:
        df = df.where(F.col("periodo_dia") == period)
    return df


def filter_incidents(df: DataFrame, types: Sequence[str] = (), severities: Sequence[str] = ()) -> DataFrame:
    if types:
        df = df.where(F.col("tipo_evento").isin(*types))
    if severities:
        df = df.where(F.col("gravedad").isin(*severities))
    return df


def named_corridors(df: DataFrame) -> DataFrame:
    return df.where(named(F.col("corredor")))


def known_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Without rows that lack a group key, as the charts leave them out."""
    return df.na.drop("any", subset=list(keys))


def finite_only(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(finite(F.col(c)))
    return df


def inside_city(df: DataFrame) -> DataFrame:
    """Located rows inside the city's box, borders included."""
    return df.na.drop("any", subset=["latitud", "longitud"]).where(
        F.col("latitud").between(6.0, 6.5) & F.col("longitud").between(-75.8, -75.3))
