"""Reading raw sensor files and tables."""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calzada.sources.schemas import HEADERS, RAW_COLUMNS, raw_schema

YEAR_FOLDER = r"/(?:\w+=)?(\d+)/[^/]*$"


def folder_year() -> Column:
    """Year from the digit-named folder that holds the file (``2019/`` or ``anio=2019/``)."""
    return F.regexp_extract(F.col("_metadata.file_path"), YEAR_FOLDER, 1).try_cast("int")


def discover_inputs(spark: SparkSession, base: str, suffix: str = ".csv") -> DataFrame:
    """(year, file, size) of every input below ``base``: right suffix in any case, digit-named folder.

    Temporary files (``~$...``) are left out; Spark itself skips ``_`` and ``.`` files.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        .select(F.regexp_extract("path", YEAR_FOLDER, 1).alias("folder"),
                F.regexp_extract("path", r"([^/]*)$", 1).alias("archivo"), F.col("length").alias("bytes"))
    )
    keep = (F.col("folder") != "") & F.endswith(F.lower("archivo"), F.lit(suffix.lower()))
    return (
        files.where(keep & ~F.startswith("archivo", F.lit("~$")))
        .select(F.col("folder").try_cast("int").alias("anio"), "archivo", "bytes").orderBy("anio", "archivo")
    )


# Names of input files: the suffix in either case, packed or not; not the office programs' lock files.
INPUT_FILES = "[!~]*.{csv,CSV,csv.gz,CSV.gz}"
# Quotes inside a quoted cell are doubled.
QUOTING = {"quote": '"', "escape": '"'}


def _csv(spark: SparkSession, schema: T.StructType, header: bool, multi_line: bool = False):
    return (
        spark.read.schema(schema).option("header", str(header).lower()).option("encoding", "UTF-8")
        .option("recursiveFileLookup", "true").option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false").option("pathGlobFilter", INPUT_FILES)
        .option("multiLine", str(multi_line).lower()).options(**QUOTING)
    )


def with_folder_year(df: DataFrame) -> DataFrame:
    """Adds ``anio_carpeta``; files that are not in a digit-named folder are no input."""
    return df.select("*", folder_year().alias("anio_carpeta")).where("anio_carpeta IS NOT NULL")


def pad_columns(df: DataFrame) -> DataFrame:
    """All raw columns in order; the missing ones as NULL text."""
    missing = {c: F.lit(None).cast("string") for c in RAW_COLUMNS if c not in df.columns}
    rest = [c for c in df.columns if c not in RAW_COLUMNS]
    return df.withColumns(missing).select(*RAW_COLUMNS, *rest)


def read_positional(spark: SparkSession, paths: str | Sequence[str], n_columns: int = len(RAW_COLUMNS),
                    header: bool = True, multi_line: bool = False) -> DataFrame:
    """Text columns named by position, short files padded, plus ``anio_carpeta`` from the folder.

    Columns past the 25 known ones are dropped by the reader. ``multi_line`` allows line breaks inside quoted
    cells; a file is then read by one task.
    """
    n = min(n_columns, len(RAW_COLUMNS))
    df = with_folder_year(_csv(spark, raw_schema(n), header, multi_line).csv(paths))
    return pad_columns(df)


def rename_by_header(df: DataFrame, spellings: Mapping[str, Iterable[str]] = HEADERS) -> DataFrame:
    """Known columns under their standard name; several spellings of one column are merged."""
    plan = []
    for target in RAW_COLUMNS:
        present = [F.col(f"`{a}`") for a in (*spellings[target], target) if a in df.columns]
        value = F.coalesce(*present) if present else F.lit(None).cast("string")
        plan.append(value.alias(target))
    return df.select(*plan, *[c for c in ("anio_carpeta",) if c in df.columns])


def _by_position(names: Sequence[str]) -> T.StructType:
    """Columns of a header line; of a name that comes again, in any case, the first keeps it."""
    seen: set[str] = set()
    fields = []
    for i, name in enumerate(names):
        fields.append(T.StructField(name if name and name.lower() not in seen else f"_columna_{i}", T.StringType()))
        seen.add(name.lower())
    return T.StructType(fields)


def literal_path(path: str) -> str:
    """A path whose brackets, braces and stars stand for themselves."""
    return re.sub(r"([][{}*?\\])", r"\\\1", path)


def header_layouts(spark: SparkSession, files: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Header cells and the files that begin with them, from one distributed scan.

    Of each file only its first block counts, which one task reads in order, and of that the first line: a line for each file
    leaves the tasks, and files are put together by their line before anything reaches the driver. Empty files have none.
    """
    lines = spark.read.text([literal_path(f) for f in files]).where(F.col("_metadata.file_block_start") == 0)
    lines = lines.select("value", F.col("_metadata.file_path").alias("archivo"), F.monotonically_increasing_id().alias("lugar"))
    heads = lines.groupBy("archivo").agg(F.min_by("value", "lugar").alias("cabecera"))
    layouts = heads.groupBy("cabecera").agg(F.sort_array(F.collect_list("archivo")).alias("archivos")).orderBy("cabecera").collect()
    out: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for r in layouts:
        out[tuple(next(csv.reader([r.cabecera]), ()))] += [unquote(a) for a in r.archivos]
    return out


def read_by_header(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Files with differing headers as one frame.

    Files that share a header are read as one scan, so the plan grows with the number of distinct layouts and not with the files.
    """
    parts = [rename_by_header(with_folder_year(_csv(spark, _by_position(names), header=True).csv([literal_path(p) for p in paths])))
             for names, paths in (header_layouts(spark, files) if files else {}).items()]
    if not parts:
        raise ValueError("no input files")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def select_by_position(df: DataFrame, folder_year_column: str = "anio_carpeta") -> DataFrame:
    """Row-mode layout: month number and year cells are not trusted.

    The year is the folder's, the month number is worked out later from the month name.
    """
    return pad_columns(df).withColumns({"mes_num": F.lit(None).cast("string"),
                                        "anio": F.col(folder_year_column).cast("string")})


def drop_empty_rows(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    """Without the rows whose cells are all NULL (blank text is not NULL)."""
    return df.na.drop("all", subset=list(columns))


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


# Stored bytes that one task takes on where rows get much wider than they are stored.
PIECE = 16 << 20


def stored_bytes(df: DataFrame) -> int:
    """Size of the files a frame reads."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in df.inputFiles()]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)


def pieces_of(df: DataFrame, piece: int = PIECE) -> int:
    """Into how many pieces the files that a frame reads are handed out; all cores get one."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-stored_bytes(df) // piece))


def spread(df: DataFrame, *keys: str, piece: int = PIECE) -> DataFrame:
    """Ahead of CPU-heavy work that widens the rows, hand a source out to all cores, in pieces that do not grow with it.

    A source that has as many splits already is left as it is.
    """
    pieces = pieces_of(df, piece)
    return df if df.rdd.getNumPartitions() >= pieces else df.repartition(pieces, *keys)


def jdbc_options(url: str, table: str, **extra: str) -> dict[str, str]:
    return {"url": url, "dbtable": table, **{k: str(v) for k, v in extra.items()}}


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int,
              fetch_rows: int = 200_000, **extra: str) -> DataFrame:
    """A database table read in parallel key ranges, each fetched in chunks."""
    options = jdbc_options(url, table, partitionColumn=key, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, fetchsize=fetch_rows, **extra)
    return spark.read.format("jdbc").options(**options).load()


def run_sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """A SQL query over the named frames (written ``{name}`` in the text) and the session's views."""
    return spark.sql(text, **tables)


