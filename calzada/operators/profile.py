"""Column profiles: null counts, value counts, summary statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calzada.operators.brackets import bracketed_quantiles, finite, fractions, sketch

QUARTILES = (0.25, 0.5, 0.75)


def null_profile(df: DataFrame) -> DataFrame:
    """(columna, nulos, porcentaje) from one pass over the table."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (
        counts.unpivot("_rows", list(df.columns), "columna", "nulos")
        .select("columna", "nulos", (F.try_divide(F.col("nulos"), F.col("_rows")) * 100).alias("porcentaje"))
    )


def top_nulls(df: DataFrame, n: int = 10) -> DataFrame:
    return null_profile(df).orderBy(F.desc("nulos"), "columna").limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value, missing ones left out, most frequent first."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("total"))
        .orderBy(F.desc("total"), column)
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """count, mean, std, min, exact quartiles and max, one row per numeric column; runs when called.

    Two scans, whatever the values: the second one takes the quartiles from the brackets that the sketches of the first give.
    """
    columns = list(columns or numeric_columns(df))
    made = "columna string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    if not columns:
        return df.sparkSession.createDataFrame([], made)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    first = values.agg(*[F.struct(
        F.count(c).alias("count"), F.round(F.avg(c), digits).alias("mean"), F.round(F.stddev(c), digits).alias("std"), F.min(c).alias("min"),
        F.max(c).alias("max"), F.count(finite(c)).alias("n"), sketch(finite(c), fractions(QUARTILES)).alias("points")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    base = dict(zip(columns, first))
    found = bracketed_quantiles(values, columns, QUARTILES, {(None, c): (base[c]["n"], base[c]["points"]) for c in columns})
    rows = [(c, base[c]["count"], base[c]["mean"], base[c]["std"], base[c]["min"], *(found.get((None, c, q)) for q in QUARTILES), base[c]["max"])
            for c in columns]
    table = df.sparkSession.createDataFrame(rows, made)
    return table.withColumns({p: F.round(p, digits) for p in ("p25", "p50", "p75")})


def column_types(df: DataFrame) -> DataFrame:
    """(orden, columna, tipo) of every column; metadata only, no job."""
    return df.sparkSession.createDataFrame([(i, *pair) for i, pair in enumerate(df.dtypes, 1)], "orden int, columna string, tipo string")


def schema_table(df: DataFrame) -> list[tuple[str, str]]:
    """(column, type) pairs; metadata only, no job."""
    return list(df.dtypes)
