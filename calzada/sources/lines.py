"""Raw lines of delimited files, and whether they fit a layout.

The lines are read whole, so that no line, whatever it holds, can stop the CSV parser; only those found to fit are handed to it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calzada.sources.readers import INPUT_FILES, QUOTING, folder_year, pad_columns
from calzada.sources.schemas import RAW_COLUMNS

REJECTED = "registro"

# Commas and quotes mean nothing while lines are read; the separator is a control character that no cell should hold.
_WHOLE = {"sep": "\u0001", "quote": "", "escape": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_entera",
          "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}


def read_lines(reader, paths: str | Sequence[str], header: bool = True, files: str = INPUT_FILES) -> DataFrame:
    """(linea, anio_carpeta, archivo) of a batch or stream reader's files; the first line of each is left out with ``header``.

    Blank lines are no rows. A line that does hold the control character comes whole all the same.
    """
    rows = (reader.schema("linea string, _entera string").option("header", str(header).lower()).options(**_WHOLE)
            .option("recursiveFileLookup", "true").option("pathGlobFilter", files).csv(paths))
    return rows.select(F.coalesce("_entera", "linea").alias("linea"), folder_year().alias("anio_carpeta"),
                       F.col("_metadata.file_path").alias("archivo")).where("anio_carpeta IS NOT NULL")


def _commas(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))


def _step(state: Column, piece: Column) -> Column:
    """One piece between two quotes. ``abierta``: the piece is inside a quoted cell; ``cerrada``: a closing quote came before it."""
    outside = ~state["abierta"]
    # A quote opens a cell at its start, or goes on with the one it has just closed (a doubled quote); elsewhere it is a character.
    opens = outside & (F.endswith(piece, F.lit(",")) | ((piece == "") & (state["cerrada"] | state["primera"])))
    return F.struct(opens.alias("abierta"), state["abierta"].alias("cerrada"), F.lit(False).alias("primera"),
                    (state["comas"] + F.when(outside, _commas(piece)).otherwise(0)).alias("comas"))


def _judge(line: Column, verdict: Callable[[Column, Column], Column]) -> Column:
    """``verdict`` of (number of cells, ends inside a quoted cell), from one step for each piece between two quotes."""
    start = F.struct(F.lit(False).alias("abierta"), F.lit(False).alias("cerrada"), F.lit(True).alias("primera"), F.lit(0).alias("comas"))
    pieces = F.split(line, '"')
    # No quote follows the last piece; whether it is inside a cell is what the step before has left.
    def end(state: Column) -> Column:
        last = F.when(state["abierta"], 0).otherwise(_commas(F.element_at(pieces, -1)))
        return verdict(state["comas"] + last + 1, state["abierta"])

    quoted = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, _step, end)
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(verdict(_commas(line) + 1, F.lit(False)))


def line_shape(line: Column) -> Column:
    """(celdas, abierta): how many cells a line has, and whether it ends inside a quoted one; linear in its length."""
    return _judge(line, lambda cells, open: F.struct(cells.alias("celdas"), open.alias("abierta")))


def fits(line: Column, widest: int) -> Column:
    """No more cells than ``widest``, and no quote left open."""
    return _judge(line, lambda cells, open: ~open & (cells <= widest))


def cells(lines: DataFrame, columns: Sequence[str], widest: int) -> DataFrame:
    """The lines' cells as text columns. ``registro`` holds a line that does not fit, whose cells are then NULL."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", **QUOTING}
    # Both come out of one-element arrays: the optimizer carries neither expression into later conditions and cells, and has no
    # aliases of cells to try in every combination.
    rows = lines.select("*", F.explode(F.array(F.when(~fits(F.col("linea"), widest), F.col("linea")))).alias(REJECTED))
    read = F.from_csv(F.when(F.col(REJECTED).isNull(), F.col("linea")), F.lit(schema), options)
    rest = [c for c in lines.columns if c != "linea"]
    return rows.select("*", F.inline(F.array(read))).select(*columns, *rest, REJECTED)


def read_rows(reader, paths: str | Sequence[str], n_columns: int = len(RAW_COLUMNS), widest: int | None = None, header: bool = True,
              files: str = INPUT_FILES) -> DataFrame:
    """All raw columns as text, ``anio_carpeta``, ``archivo`` and, in ``registro``, the lines that do not fit.

    Short rows are padded. A row does not fit if it has more than ``widest`` cells (default: than columns) or leaves a quote open;
    of one that fits, cells past the columns are dropped.
    """
    names = RAW_COLUMNS[:n_columns]
    return pad_columns(cells(read_lines(reader, paths, header, files), names, max(widest or n_columns, 1)))
