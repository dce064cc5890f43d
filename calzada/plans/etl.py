"""Batch ETL: raw files to the cleaned table with its index, and the run's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calzada.operators.cleaning import clean, clean_for_csv
from calzada.operators.congestion import congestion_index
from calzada.operators.sampling import exact_sample
from calzada.sources.lines import REJECTED, read_rows
from calzada.sources.readers import drop_empty_rows, select_by_position
from calzada.sources.schemas import RAW_COLUMNS
from calzada.sources.workspace import drop_folder, materialise, new_folder
from calzada.sources.writers import write_csv_by_year, write_parquet, write_parquet_by_year


def csv_job(raw: DataFrame, target: str, compression: str | None = None) -> None:
    """Raw rows to one cleaned CSV folder per year."""
    write_csv_by_year(raw.transform(drop_empty_rows).transform(select_by_position).transform(clean_for_csv), target, compression=compression)


def traffic_table(raw: DataFrame, method: str = "p95_year", fraction: float | None = None, seed: int = 42,
                  null_text: str = "null") -> DataFrame:
    """Cleaned rows with derived columns and index. A sample, if asked for, is drawn before the index."""
    # An exact share of each file, or of each folder where files are not known. It follows from the rows, but is costly to draw twice.
    group = "archivo" if "archivo" in raw.columns else "anio_carpeta"
    rows = raw if fraction is None else materialise(exact_sample(raw, fraction, seed, group), "muestra")
    return congestion_index(clean(rows, null_text=null_text), method)


def parquet_job(spark: SparkSession, source: str, yearly: str, unified: str | None = None,
                fraction: float | None = None, n_columns: int = 25, widest: int = 1_000) -> DataFrame:
    """Raw CSV folders to Parquet per year and, if wanted, one unified table; returns the summary.

    Lines with more than ``widest`` cells or a quote left open go as they are to the folder beside ``yearly`` that ends in
    ``_rechazos``; of the others, cells past the columns are dropped.

    The cleaned rows go to the work folder without their index first: its divisors need a second look
    at the data, and reading one Parquet column again is far cheaper than parsing the text twice. That copy is
    deleted at the end, also after a failure. Tables are kept by the year of the *folder* (``anio_carpeta``): a run
    replaces the folders it has read and no others, whatever years their cells name. Summary and unified table
    cover the folders of this run.
    """
    bad = F.col(REJECTED).isNotNull()
    raw = read_rows(spark.read, source, n_columns, widest).where(bad | ~F.forall(F.array(*RAW_COLUMNS), lambda c: c.isNull()))
    rows = raw if fraction is None else exact_sample(raw, fraction)
    staged = new_folder(spark, "sin_indice")
    try:
        write_parquet_by_year(clean(rows, keep=("anio_carpeta", REJECTED)), staged, "anio_carpeta", sort_by=None)
        read = spark.read.parquet(staged)
        rejects = read.where(bad).select("anio_carpeta", F.col(REJECTED).alias("value"))
        if not rejects.isEmpty():
            (rejects.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("anio_carpeta")
             .text(f"{yearly.rstrip('/')}_rechazos"))
        indexed = read.where(~bad).drop(REJECTED)
        folders = [r.anio_carpeta for r in indexed.select("anio_carpeta").distinct().collect()]
        write_parquet_by_year(congestion_index(indexed), yearly, "anio_carpeta")
    finally:
        drop_folder(spark, staged)
    table = spark.read.parquet(yearly).where(F.col("anio_carpeta").isin(folders)).drop("anio_carpeta")
    if unified:
        write_parquet(table, unified)
    return run_summary(table)


def run_summary(trafico: DataFrame) -> DataFrame:
    """(registros, anios, corredores): rows, distinct years and distinct corridors."""
    return trafico.agg(F.count("*").alias("registros"), F.countDistinct("anio").alias("anios"),
                       F.countDistinct("corredor").alias("corredores"))


def corridor_list(trafico: DataFrame) -> DataFrame:
    return trafico.where(F.col("corredor").isNotNull()).select("corredor").distinct().orderBy("corredor")


def union_years(*years: DataFrame) -> DataFrame:
    """Yearly tables as one, columns matched by name."""
    out, *rest = years
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
