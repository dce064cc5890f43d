"""What has happened to each input file: a table that is only ever added to.

An event tells that an attempt to load a file has begun, has loaded it or has failed; the latest event of a path is its state. Each
attempt writes to a place of its own (``lote``), named by the full digest of the path and the number of the attempt,
and readers open only the places of attempts that have loaded. So a run may end anywhere: what it left half done is
never seen, and the next run begins it anew.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BEGUN, LOADED, FAILED = "empezado", "cargado", "fallido"
EVENT = "archivo string, bytes bigint, modificado timestamp, intento int, estado string, lote string, error string, momento timestamp"


@dataclass(frozen=True)
class File:
    """An input file, its path as readers show it (``ruta``, escaped), and the number of attempts so far."""

    archivo: str
    ruta: str
    bytes: int
    modificado: object
    intento: int = 0


def place(path: Column, attempt: Column) -> Column:
    """The ``lote`` an attempt writes to."""
    return F.concat(F.lit("f"), F.sha2(path, 256), F.lit("."), attempt.cast("string"))


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def events(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).parquet(self.folder)

    def append(self, files: Iterable[File], state: str, error: str | None = None) -> None:
        """One file of events, put in place as a whole."""
        rows = [(f.archivo, f.bytes, f.modificado, f.intento, state, error) for f in files]
        if not rows:
            return
        frame = self.spark.createDataFrame(rows, "archivo string, bytes bigint, modificado timestamp, intento int, estado string, error string")
        lot = place(F.col("archivo"), F.col("intento"))
        frame.select("archivo", "bytes", "modificado", "intento", "estado", lot.alias("lote"), "error",
                     F.current_timestamp().alias("momento")).coalesce(1).write.mode("append").parquet(self.folder)

    def latest(self) -> DataFrame:
        """The latest event of each path: highest attempt, its end before its beginning. Combines before the shuffle."""
        order = F.struct("intento", (F.col("estado") != BEGUN).alias("fin"), (F.col("estado") == LOADED).alias("bien"), "momento")
        last = self.events().groupBy("archivo").agg(F.max_by(F.struct("bytes", "modificado", "intento", "estado", "lote", "error", "momento"), order).alias("e"))
        return last.select("archivo", "e.*")

    def loaded(self) -> DataFrame:
        """(archivo, lote) to read for each path: that of its latest attempt that has loaded, whatever has begun since."""
        done = self.events().where(F.col("estado") == LOADED)
        return done.groupBy("archivo").agg(F.max_by("lote", "intento").alias("lote"))

    def pending(self, listed: DataFrame) -> list[File]:
        """Listed files that are new, have changed since they were loaded, or whose last attempt has not ended well.

        ``listed``: archivo, ruta, bytes, modificado. They come in the order of their last change.
        """
        known = self.latest().select("archivo", "intento", F.struct("bytes", "modificado", "estado").alias("visto"))
        same = F.col("visto").eqNullSafe(F.struct("bytes", "modificado", F.lit(LOADED).alias("estado")))
        todo = listed.join(known, "archivo", "left").where(~same).orderBy("modificado", "archivo")
        return [File(*r[:4], r.intento or 0) for r in todo.select("archivo", "ruta", "bytes", "modificado", "intento").collect()]
