"""Incremental ingest: new files are found and loaded, through a ledger or as a stream.

:func:`ingest_new_files` lists the input, loads what the ledger of files does not know as loaded, and notes every step;
:func:`csv_stream` is a stateless stream from files to files, whose source and sinks remember what they have done.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calzada.operators.cleaning import clean, clean_for_csv
from calzada.sources.lines import REJECTED, read_rows
from calzada.sources.readers import INPUT_FILES, YEAR_FOLDER, drop_empty_rows, literal_path, select_by_position
from calzada.sources.schemas import RAW_COLUMNS
from calzada.streaming.ledger import BEGUN, FAILED, LOADED, File, Ledger, place

FILES_PER_BATCH = 1_000


def raw_stream(spark: SparkSession, source: str, n_columns: int = len(RAW_COLUMNS),
               files_per_batch: int = FILES_PER_BATCH, keep_rejected: bool = True, header: bool = True,
               files: str = INPUT_FILES) -> DataFrame:
    """Raw text columns, the folder's year, and the original line of rows that do not fit.

    ``source`` may be a glob such as ``base/*`` for year folders. Short rows are padded; a row with more cells
    than columns, or with a quote left open, does not fit: it is kept with empty cells, or left out.
    """
    rows = read_rows(spark.readStream.option("maxFilesPerTrigger", str(files_per_batch)), source, n_columns, header=header, files=files)
    return rows.drop("archivo") if keep_rejected else rows.where(F.col(REJECTED).isNull()).drop("archivo", REJECTED)


def _typed_batch(batch: DataFrame) -> DataFrame:
    """Cleaned rows and rejected lines in one frame, so that one pass over the files feeds both."""
    bad = F.col(REJECTED).isNotNull()
    empty = F.forall(F.array(*RAW_COLUMNS), lambda c: c.isNull())
    return clean(batch.where(bad | ~empty).withColumn("rechazada", bad), keep=("lote", "rechazada", REJECTED))


def _write_batch(target: str):
    """Writes rows to the places their ``lote`` names (the batch's number where they have none), replacing what is there."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if "lote" in batch.columns else batch.withColumn("lote", F.lit(str(batch_id)))
        (_typed_batch(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("lote", "rechazada", "anio").parquet(target))
    return write


def ledger_of(spark: SparkSession, target: str) -> Ledger:
    """The ledger of files beside a target."""
    return Ledger(spark, f"{target.rstrip('/')}_libro")


def failed_files(spark: SparkSession, target: str) -> DataFrame:
    """(archivo, error) of the files whose last attempt failed; each run tries them again."""
    return ledger_of(spark, target).latest().where(F.col("estado") == FAILED).select("archivo", "error")


def list_inputs(spark: SparkSession, source: str | Sequence[str], files: str = INPUT_FILES) -> DataFrame:
    """(archivo, ruta, bytes, modificado) of the files in digit-named folders; nothing is read of them."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", files).load(source)
              .select(F.col("path").alias("archivo"), F.col("_metadata.file_path").alias("ruta"), F.col("length").alias("bytes"),
                      F.col("modificationTime").alias("modificado")))
    return listed.where(F.regexp_extract("archivo", YEAR_FOLDER, 1) != "")


def _load(spark: SparkSession, ledger: Ledger, target: str, files: list[File], n_columns: int, header: bool, pattern: str) -> int:
    """Load some files and note it; the number loaded. Where one cannot be read, halves are tried, down to the file itself."""
    files = [replace(f, intento=f.intento + 1) for f in files]
    ledger.append(files, BEGUN)
    attempts = spark.createDataFrame([(f.ruta, f.archivo, f.intento) for f in files], "ruta string, archivo string, intento int")
    rows = read_rows(spark.read, [literal_path(f.archivo) for f in files], n_columns, header=header, files=pattern)
    # At most a batch of files: a line each.
    lots = attempts.select(F.col("ruta").alias("archivo"), place(F.col("archivo"), F.col("intento")).alias("lote"))
    try:
        _write_batch(target)(rows.join(F.broadcast(lots), "archivo"), 0)
    except Exception as error:
        if len(files) == 1:
            ledger.append(files, FAILED, str(error).strip().splitlines()[0][:500])
            return 0
        half = len(files) // 2
        return sum(_load(spark, ledger, target, part, n_columns, header, pattern) for part in (files[:half], files[half:]))
    ledger.append(files, LOADED)
    return len(files)


def ingest_new_files(spark: SparkSession, source: str | Sequence[str], target: str, checkpoint: str | None = None, n_columns: int = len(RAW_COLUMNS),
                     files_per_batch: int = FILES_PER_BATCH, header: bool = True, files: str = INPUT_FILES) -> bool:
    """Load the files not loaded so far into ``target``; true if there were any.

    A file is known by its whole path, so equal names in two year folders are two files; one that has changed since it
    was loaded is loaded again and its old rows are no longer read. A damaged file loads nothing: the ledger
    notes it (:func:`failed_files`), the other files of its batch are loaded, and every later run tries it again.
    The run may be ended at any point and started again. One run at a time may write to a target.
    ``checkpoint``, the log of earlier versions, is not needed any more.
    """
    ledger = ledger_of(spark, target)
    todo = ledger.pending(list_inputs(spark, source, files))
    batches = [todo[at:at + files_per_batch] for at in range(0, len(todo), files_per_batch)]
    return sum(_load(spark, ledger, target, batch, n_columns, header, files) for batch in batches) > 0


def _stored(spark: SparkSession, target: str) -> DataFrame:
    """Rows and rejected lines of the places that count; the others are not even listed where the join prunes them."""
    table = spark.read.parquet(target)
    ledger = ledger_of(spark, target)
    return table.join(ledger.loaded().select("lote"), "lote", "left_semi") if ledger.exists() else table


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """The typed rows loaded so far."""
    table = _stored(spark, target)
    return table.where(~F.col("rechazada").cast("boolean")).drop("rechazada", REJECTED, "lote")


def rejected(spark: SparkSession, target: str) -> DataFrame:
    """Lines that did not fit the layout."""
    return _stored(spark, target).where(F.col("rechazada").cast("boolean")).select("lote", REJECTED)


def csv_stream(spark: SparkSession, source: str, target: str, checkpoint: str,
               n_columns: int = len(RAW_COLUMNS), files_per_batch: int = FILES_PER_BATCH, rejects: str | None = None,
               compression: str | None = None) -> None:
    """New files to cleaned CSV, one folder per year, quoted as RFC 4180 says; a stateless append. ``compression`` is that of the cleaned files.

    Lines that do not fit go as they are to the folder ``rejects`` (default: beside the target), by a stream of its own: each of the two
    file sinks writes every input file exactly once.
    """
    rows = raw_stream(spark, source, n_columns, files_per_batch)
    good = rows.where(F.col(REJECTED).isNull()).drop(REJECTED)
    cleaned = good.transform(drop_empty_rows).transform(select_by_position).transform(clean_for_csv)
    bad = rows.where(F.col(REJECTED).isNotNull()).select("anio_carpeta", F.col(REJECTED).alias("value"))
    packed = {"compression": compression} if compression else {}
    sinks = [
        cleaned.writeStream.format("csv").option("header", "true").option("escape", '"').options(**packed)
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        .option("checkpointLocation", checkpoint).option("path", target).partitionBy("anio"),
        bad.writeStream.format("text").option("checkpointLocation", f"{checkpoint.rstrip('/')}_rechazos")
        .option("path", rejects or f"{target.rstrip('/')}_rechazos").partitionBy("anio_carpeta"),
    ]
    running = [sink.outputMode("append").trigger(availableNow=True).start() for sink in sinks]
    for query in running:
        query.awaitTermination()
