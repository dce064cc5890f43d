"""The congestion index kept up to date, batch by batch, without reading earlier readings.

Each batch adds its number of readings for each (year, occupancy) to a table of counts; counts of batches add up, so the exact 95th
percentile of a year follows from the counts of that year alone. Only years a batch has touched are worked out again. The index
itself is not stored with the readings, whose divisor a later batch may change, but attached when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calzada.functions.numbers import unit_clip, upper_clip
from calzada.operators.brackets import finite
from calzada.operators.quantiles import quantiles_of_counts
from calzada.sources.versions import VersionedTable

COUNTS = "valor double, n bigint, lote string, anio int"
DIVISORS = "anio int, p95 double"


class RunningIndex:
    """Counts below ``folder/conteos``, one folder for each batch and year; the divisors in a versioned table beside them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.divisors = VersionedTable(spark, f"{self.folder}/p95")

    def counts(self) -> DataFrame:
        return self.spark.read.schema(COUNTS).parquet(f"{self.folder}/conteos")

    def add(self, batch: DataFrame, name: str) -> list[int]:
        """Take in the readings of a batch; the years it touches. A batch that is added again under its name replaces itself."""
        rows = batch.where("anio IS NOT NULL").select(F.col("anio").cast("int").alias("anio"), finite("ocupacion").alias("valor"))
        made = rows.groupBy("anio", "valor").agg(F.count("*").alias("n")).withColumn("lote", F.lit(name))
        at = f"{self.folder}/conteos"
        # Years an earlier try of this batch has left behind go with its folder.
        made.write.mode("overwrite").partitionBy("anio").parquet(f"{at}/lote={name}")
        touched = [r.anio for r in self.counts().where(F.col("lote") == name).select("anio").distinct().collect()]
        self._renew(touched)
        return sorted(touched)

    def _renew(self, years: list[int]) -> None:
        """The divisors of some years from their counts; those of the others stay."""
        own = self.counts().where(F.col("anio").isin(years) & F.col("valor").isNotNull())
        total = own.groupBy("anio", F.col("valor").alias("v")).agg(F.sum("n").alias("n"))
        new = quantiles_of_counts(total, "anio", [0.95]).select("anio", F.col("valor").alias("p95"))
        if self.divisors.versions():
            new = new.unionByName(self.p95().where(~F.col("anio").isin(years)))
        self.divisors.reload(new.coalesce(1))

    def p95(self) -> DataFrame:
        """(anio, p95) of all readings so far."""
        return self.divisors.read(DIVISORS)

    def index(self) -> DataFrame:
        """(anio, ocupacion, n, indice_congestion): the index of each occupancy of each year and how many readings have it."""
        total = self.counts().groupBy("anio", F.col("valor").alias("ocupacion")).agg(F.sum("n").alias("n"))
        return self.attach(total)

    def attach(self, readings: DataFrame, method: str = "p95_year") -> DataFrame:
        """Readings with ``indice_congestion`` as of now; ``max_valid`` takes its divisor from the counts, too."""
        occ = F.col("ocupacion")
        if method == "max_valid":
            valid = self.counts().where((F.col("valor") > 0) & (F.col("valor") < 1000))
            top = valid.agg(F.coalesce(F.max("valor"), F.lit(1.0)).alias("m")).scalar()
            return readings.withColumn("indice_congestion", upper_clip(F.try_divide(occ, top)))
        if method != "p95_year":
            raise ValueError(f"method must be p95_year or max_valid, not {method!r}")
        joined = readings.drop("indice_congestion").join(self.p95(), "anio", "left")
        value = F.when(F.coalesce("p95", F.lit(0.0)) > 0, unit_clip(F.try_divide(occ, F.col("p95")))).otherwise(F.lit(0.0))
        return joined.withColumn("indice_congestion", value).drop("p95")
