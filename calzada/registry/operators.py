"""Entries S, C, G, P, J, A, W, T, F and R: single operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from calzada.functions import dates, numbers, text
from calzada.functions import traffic as tr
from calzada.operators import cleaning, clustering, congestion, filters, geo, profile, running, sampling
from calzada.operators.quantiles import exact_quantiles
from calzada.plans import analytics, dashboard, etl, forecast
from calzada.registry.base import Entry
from calzada.registry.fixture import Fixture
from calzada.registry.oracle import month_no, num, period, position, rush, title, whole
from calzada.sources import catalog, export, readers, writers
from calzada.sources.schemas import CRITICAL_ZONES, HEADERS, RAW_COLUMNS
from calzada.sources.versions import VersionedTable
from calzada.sources.workspace import drop_folder, materialise, short_lived_shuffles, stored, unsorted_writes
from calzada.streaming import ingest

_TEXT_COLUMNS = ("carril", "corredor", "comuna", "dia_semana", "mes", "sentido", "operacion", "tipo_subsistema", "identificador_fv")


def _counted(df, *columns):
    """Distinct results of an operator with their number of rows."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


# Between the cells of a packed row, and a cell that is missing.
_BETWEEN, _MISSING = "\x1f", "\x1e"


def _packed(df, texts):
    """The text columns as one (``_fila``), which takes less than half the room; rows that hold one of the two marks keep their cells (``_celdas``)."""
    plain = ~F.contains(F.concat_ws("", *texts), F.lit(_BETWEEN)) & ~F.contains(F.concat_ws("", *texts), F.lit(_MISSING))
    return df.withColumns({"_fila": F.when(plain, F.concat_ws(_BETWEEN, *[F.coalesce(c, F.lit(_MISSING)) for c in texts])),
                           "_celdas": F.when(~plain, F.struct(*texts))}).drop(*texts)


def _unpacked(df, texts):
    cells = df.withColumn("_partes", F.split("_fila", _BETWEEN))
    return cells.withColumns({c: F.when(F.col("_fila").isNull(), F.col("_celdas")[c]).otherwise(F.nullif(F.get("_partes", F.lit(i)), F.lit(_MISSING)))
                              for i, c in enumerate(texts)}).drop("_fila", "_celdas", "_partes")


def _counted_rows(df, *columns):
    """As :func:`_counted` for wide rows that seldom repeat: dealt out first, since tasks that counted before would only fill their memory and spill."""
    rows = df.select(*columns)
    texts = [c for c, kind in rows.dtypes if kind == "string"]
    keyed = rows.withColumn("_reparto", F.xxhash64(*columns))
    dealt = (_packed(keyed, texts) if len(texts) > 1 else keyed).repartition("_reparto")
    counted = _counted(dealt, *dealt.columns)
    return (_unpacked(counted, texts) if len(texts) > 1 else counted).select(*columns, "n")


def _every_row(df):
    """All rows, each with how often it is there."""
    return _counted_rows(df, *df.columns)


def _mapped(column: str, **outputs):
    """Each distinct raw cell of a column next to what the operators make of it."""
    def run(f: Fixture):
        cell = F.col(column)
        return _counted(f.raw.select(cell.alias("celda"), *[op(cell).alias(n) for n, op in outputs.items()]), "celda", *outputs)
    return run


def _mapped_sql(column: str, **outputs: str) -> str:
    shown = ", ".join(f"{e} AS {n}" for n, e in outputs.items())
    return f"SELECT {column} AS celda, {shown}, COUNT(*) AS n FROM trafico_raw GROUP BY ALL"


def _land(f: Fixture, name: str, columns=None, rename=None, compression=None):
    """The raw rows as CSV files in one folder per year, as they would arrive."""
    path = f.folder(name)
    df = f.raw.select(*(columns or RAW_COLUMNS), "anio_carpeta")
    if rename:
        df = df.withColumnsRenamed(rename)
    with short_lived_shuffles(f.spark):
        writers.write_csv_by_year(df, path, year="anio_carpeta", compression=compression)
    return path


def _raw_by_year(f: Fixture):
    """The raw rows as a packed table by year, and its folder; files of whole years are written from it."""
    return stored(f.raw.select(*RAW_COLUMNS, "anio_carpeta"), "crudo", "zstd", by=["anio_carpeta"])


_LANDED = ", ".join(RAW_COLUMNS)


def _by_year(df, year="anio"):
    return df.groupBy(year).agg(
        F.count("*").alias("filas"), F.count("velocidad_kmh").alias("velocidades"), F.sum("velocidad_kmh").alias("suma_velocidad"),
        F.count("corredor").alias("con_corredor"), F.max("corredor").alias("corredor_max"))


_BY_YEAR = """COUNT(*) AS filas, COUNT(velocidad_kmh) AS velocidades, SUM(velocidad_kmh) AS suma_velocidad,
    COUNT(corredor) AS con_corredor, MAX(corredor) AS corredor_max"""


def _discovered(f: Fixture):
    """One file a year among files that are no input: another suffix, a folder without digits. With the rows that the files found hold."""
    base = f.folder("entradas")
    rows, copy = _raw_by_year(f)
    # Only the files that are input need one task for each year; shuffles end with the query that made them.
    with short_lived_shuffles(f.spark), unsorted_writes(f.spark):
        writers.write_csv_file_by_year(rows, base, "anio_carpeta")
        rows.write.mode("append").partitionBy("anio_carpeta").json(base, compression="gzip")
        writers.write_csv_by_year(rows.limit(10).withColumn("borrador", F.lit("sin")), base, year="borrador", mode="append")
    drop_folder(f.spark, copy)
    found = readers.discover_inputs(f.spark, base)
    lines = f.spark.read.option("recursiveFileLookup", "true").text(base).select(readers.folder_year().alias("anio"), F.col("_metadata.file_name").alias("archivo"))
    # The first line of a file is its header.
    return found.join(lines.groupBy("anio", "archivo").agg(F.count("*").alias("n")), ["anio", "archivo"]).groupBy("anio").agg(F.count("*").alias("archivos"), F.sum(F.col("n") - 1).alias("filas"))


def _positional(f: Fixture):
    return _counted_rows(readers.read_positional(f.spark, _land(f, "posicional", RAW_COLUMNS[:22], compression="gzip"), 22), "anio_carpeta", *RAW_COLUMNS)


def _by_header(f: Fixture):
    """Two landings with different spellings and one without the intensity column, read as one."""
    paths = []
    for i, name in enumerate(("cabecera_a", "cabecera_b")):
        dropped = () if i == 0 else ("intensidad_veh_h",)
        columns = [c for c in RAW_COLUMNS if c not in dropped]
        paths.append(_land(f, name, columns, {c: HEADERS[c][min(i, len(HEADERS[c]) - 1)] for c in columns}, compression="gzip"))
    files = [p for path in paths for p in f.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path").toPandas()["path"]]
    return _counted_rows(readers.read_by_header(f.spark, files), "anio_carpeta", *RAW_COLUMNS)


def _row_mode(f: Fixture):
    df = readers.read_positional(f.spark, _land(f, "filas", compression="gzip"))
    rows = cleaning.clean_for_csv(readers.select_by_position(readers.drop_empty_rows(df)))
    return _counted(rows, "anio", "mes_num", "mes", "hora", "sentido", "operacion")


def _csv_sink(f: Fixture):
    path = f.folder("csv")
    etl.csv_job(f.raw, path, compression="gzip")
    return _counted_rows(f.spark.read.option("header", "true").options(**readers.QUOTING).csv(path), *RAW_COLUMNS)


def _yearly_sink(f: Fixture):
    path = f.folder("por_anio")
    writers.write_parquet_by_year(f.trafico, path, balanced=True)
    # One year again: only that year's folder is replaced.
    writers.write_parquet_by_year(f.trafico.where(F.col("anio") == 1998), path)
    return _every_row(f.spark.read.parquet(path))


_CURVE = ("corredor", "fecha_trafico", "hora")


def _curve_cells(f: Fixture):
    """The 512 largest cells of the curve through corridor, date and hour, with their rows and extent in each column."""
    placed = clustering.on_curve(f.trafico, _CURVE, name="curva")
    return placed.groupBy(F.shiftright("curva", 3 * clustering.BITS - 9).alias("celda")).agg(
        F.count("*").alias("filas"), *[fn(c).alias(f"{c}_{end}") for c in _CURVE for end, fn in (("min", F.min), ("max", F.max))])


def _curve_sql() -> str:
    ranges = 2 ** clustering.BITS
    codes = ", ".join(f"""r{i} AS (SELECT v, (SUM(n) OVER (ORDER BY v) - n) * {ranges} // SUM(n) OVER () AS tramo
        FROM (SELECT {c} AS v, COUNT(*) AS n FROM trafico WHERE {c} IS NOT NULL GROUP BY 1) x)""" for i, c in enumerate(_CURVE))
    # Celda: the three highest bits of each column's range, the first column's bit ahead in every group of three.
    bits = " + ".join(f"((COALESCE(r{i}.tramo, 0)::BIGINT // {ranges >> (3 - b)}) % 2) * {2 ** (3 * b + 2 - i)}" for i in range(3) for b in range(3))
    joins = " ".join(f"LEFT JOIN r{i} ON t.{c} = r{i}.v" for i, c in enumerate(_CURVE))
    ends = ", ".join(f"MIN({c}) AS {c}_min, MAX({c}) AS {c}_max" for c in _CURVE)
    return f"WITH {codes} SELECT celda, COUNT(*) AS filas, {ends} FROM (SELECT t.*, ({bits})::BIGINT AS celda FROM trafico t {joins}) y GROUP BY celda"


# The dashboard's choices: years, corridors, day period; and the date and hour ranges that the period stands for.
_CHOICES = {"corredor": "corredor BETWEEN 'Brand#21' AND 'Brand#23'", "fecha": "fecha_trafico BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'", "hora": "hora BETWEEN 7 AND 9",
            "fecha_hora": "fecha_trafico >= DATE '1996-06-01' AND hora = 18", "todos": "corredor >= 'Brand#4' AND anio = 1995 AND periodo_dia = 'Tarde'"}


def _clustered_filters(f: Fixture):
    """What five filters find in the table stored along the curve."""
    path = f.folder("por_curva")
    writers.write_clustered_by_year(f.trafico, path, _CURVE)
    stored = f.spark.read.parquet(path)
    return stored.groupBy("anio").agg(F.count("*").alias("filas"), *[F.count_if(F.expr(c)).alias(n) for n, c in _CHOICES.items()],
                                      *[F.round(F.sum(F.when(F.expr(c), F.col("velocidad_kmh"))), 6).alias(f"suma_{n}") for n, c in _CHOICES.items()])


def _built(f: Fixture) -> str:
    """The indexed table built anew, as the other queries find it stored."""
    path = f.folder("trafico")
    writers.write_parquet_by_year(congestion.congestion_index(f.source), path)
    return path


def _unified_sink(f: Fixture):
    path = f.folder("unificado")
    writers.write_parquet(f.cleaned, path)
    return _every_row(f.spark.read.parquet(path))


def _append_and_reload(f: Fixture):
    path = f.folder("incidentes")
    writers.append_rows(f.incidentes, path)
    writers.reload_table(f.incidentes.where(F.col("anio") < 1998), path)
    writers.append_rows(f.incidentes.where(F.col("anio") >= 1998), path)
    return _every_row(f.spark.read.parquet(path))


def _reloaded(f: Fixture):
    """A table opened before a reload and one opened after it."""
    table = VersionedTable(f.spark, f.folder("incidentes"))
    table.reload(f.incidentes)
    before = table.read()
    table.reload(f.incidentes.where(F.col("anio") >= 1995), partition_by=["anio"])
    counts = [df.groupBy("anio").agg(F.count("*").alias(n)) for df, n in ((before, "antes"), (table.read(), "ahora"))]
    return counts[0].join(counts[1], "anio", "left")


def _summary_table(f: Fixture):
    table = VersionedTable(f.spark, f.folder("zonas_criticas"))
    for _ in range(2):
        table.reload(analytics.critical_zones(f.trafico))
    return table.read(CRITICAL_ZONES)


_EXPORTED = ("carril", "fecha_trafico", "fecha", "hora", "dia_semana", "dia_num", "mes_num", "mes", "anio", "velocidad_kmh", "corredor", "sentido",
             "operacion", "intensidad_veh_h", "ocupacion", "comuna", "codigo_comuna", "periodo_dia", "es_hora_pico")


def _export(f: Fixture):
    """A fifth of the table in ranges of its key, floats and small integers as narrow as they go; all columns of the copy."""
    sample = sampling.modulus_sample(f.trafico, 0.2).select("id", *_EXPORTED)
    copy = export.export_ranges(sample, f.folder("exportado"), "id", chunks=12, chunks_per_job=6)
    wide = {c: F.col(c).cast("double") for c in ("velocidad_kmh", "intensidad_veh_h", "ocupacion", "codigo_comuna")}
    return _counted(copy.withColumns(wide), "id", *_EXPORTED)


def _batch_etl(f: Fixture):
    yearly, unified = f.folder("etl"), f.folder("etl_unificado")
    etl.parquet_job(f.spark, _land(f, "crudo"), yearly, unified)
    table = f.spark.read.parquet(unified).withColumn("indice", F.round("indice_congestion", 6))
    return _loaded(table, "indice")


def _loaded(df, *more):
    """All rows as they come back from CSV: a blank cell is a missing one."""
    return _counted_rows(df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in _TEXT_COLUMNS}), *RAW_COLUMNS, "periodo_dia", "es_hora_pico", *more)


_LOADED = ", ".join(f"NULLIF({c}, '') AS {c}" if c in _TEXT_COLUMNS else c for c in RAW_COLUMNS) + ", periodo_dia, es_hora_pico"


def _ingest(f: Fixture):
    source, target = _land(f, "entrada"), f.folder("ingerido")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_new_files(f.spark, source, target, files_per_batch=25)
    return _loaded(ingest.ingested(f.spark, target))


def _ledger(f: Fixture):
    """One file a year, in two runs: what the ledger says and how many rows each file has brought."""
    source, target = f.folder("entrada"), f.folder("ingerido")
    rows, copy = _raw_by_year(f)
    writers.write_csv_file_by_year(rows, source, "anio_carpeta")
    drop_folder(f.spark, copy)
    ingest.ingest_new_files(f.spark, f"{source}/anio_carpeta=199[2-7]", target, files_per_batch=4)
    ingest.ingest_new_files(f.spark, source, target, files_per_batch=4)
    state = ingest.ledger_of(f.spark, target).latest()
    rows = f.spark.read.parquet(target).where(~F.col("rechazada")).groupBy("lote").agg(F.count("*").alias("filas"))
    return state.join(rows, "lote").select(F.regexp_extract("archivo", readers.YEAR_FOLDER, 1).cast("int").alias("anio"), "estado", "intento", "filas")


def _csv_ingest(f: Fixture):
    source, target, log = _land(f, "entrada", compression="gzip"), f.folder("csv_ingerido"), f.folder("registro")
    for _ in range(2):
        ingest.csv_stream(f.spark, source, target, log, compression="gzip")
    return _counted_rows(f.spark.read.option("header", "true").options(**readers.QUOTING).csv(target), *RAW_COLUMNS)


_CSV_CELLS = {
    **{c: f"NULLIF(trim({c}), '')" for c in RAW_COLUMNS}, "hora": f"CAST({whole('hora')} AS VARCHAR)", "mes_num": f"CAST({month_no('mes')} AS VARCHAR)",
    "anio": "anio_carpeta", "corredor": title("NULLIF(trim(corredor), '')"), "sentido": "upper(trim(sentido))", "operacion": "lower(NULLIF(trim(operacion), ''))"}
_CSV_ROWS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _CSV_CELLS.items()) + ", COUNT(*) AS n FROM crudo GROUP BY ALL"


def _rejects(f: Fixture):
    """The rows of one lane arrive with a cell too many, those of another with a quote left open."""
    source, target = f.folder("entrada"), f.folder("ingerido")
    quoted = lambda c: F.when(F.contains(c, F.lit('"')) | F.contains(c, F.lit(",")),
                              F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    line = F.concat_ws(",", *[quoted(F.col(c)) for c in RAW_COLUMNS])
    lane = F.trim("carril")
    line = F.when(lane == "carril 3", F.concat(line, F.lit(",sobra"))).when(lane == "carril 4", F.concat(line, F.lit(',"abierta'))).otherwise(line)
    f.raw.select(line.alias("value"), "anio_carpeta").write.partitionBy("anio_carpeta").text(source)
    ingest.ingest_new_files(f.spark, source, target, header=False, files="*.txt")
    taken = ingest.ingested(f.spark, target).agg(F.lit(None).cast("string").alias("registro"), F.count("*").alias("n"))
    return _counted(ingest.rejected(f.spark, target), "registro").unionByName(taken)


_LINE = "concat_ws(',', " + ", ".join(
    f"""CASE WHEN contains({c}, '"') OR contains({c}, ',') THEN '"' || replace({c}, '"', '""') || '"' ELSE COALESCE({c}, '') END""" for c in RAW_COLUMNS) + ")"


def _sampled(f: Fixture):
    """The rows of an exact sample of each year's folder, drawn from the rows cut up in another way."""
    cut = f.raw.hint("rebalance", "hora")
    return _counted_rows(sampling.exact_sample(cut, group="anio_carpeta"), "anio_carpeta", *RAW_COLUMNS)


_DRAW = "('0x' || substr(md5(concat_ws(chr(31), '42', " + ", ".join(f"COALESCE({c}, '\\N')" for c in RAW_COLUMNS) + ")), 1, 15))::BIGINT"
_SAMPLE_SQL = f"""SELECT anio_carpeta, {', '.join(RAW_COLUMNS)}, COUNT(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY anio_carpeta) AS filas,
    row_number() OVER (PARTITION BY anio_carpeta ORDER BY sorteo) AS lugar FROM (SELECT *, {_DRAW} AS sorteo FROM trafico_raw) d) x
    WHERE lugar <= round_even(0.15::DOUBLE * filas, 0) GROUP BY ALL"""


def _folded_join(f: Fixture):
    """Severities joined with their spelling in capitals and without accents."""
    levels = f.incidentes.where("gravedad IS NOT NULL").select(F.upper(F.translate("gravedad", "áéíóú", "aeiou")).alias("nivel")).distinct()
    rows = f.incidentes.groupBy("gravedad").agg(F.count("*").alias("n"))
    return rows.join(levels, text.folded(F.col("gravedad")) == text.folded(F.col("nivel"))).select("gravedad", "nivel", "n")


def _index(method: str):
    def run(f: Fixture):
        df = congestion.congestion_index(f.cleaned, method)
        return _counted(df.select("anio", "ocupacion", F.round("indice_congestion", 9).alias("indice")), "anio", "ocupacion", "indice")
    return run


def _running(f: Fixture):
    """Three batches, the third of one year only and added twice; the index as read afterwards."""
    state, year = running.RunningIndex(f.spark, f.folder("corriente")), F.col("anio")
    late = (year == 1995) & (F.col("hora") >= 12)
    for name, part in (("a", ~late & (F.col("id") % 2 == 0)), ("b", ~late & (F.col("id") % 2 == 1)), ("c", late), ("c", late)):
        state.add(f.trafico.where(part), name)
    return state.index().join(state.p95(), "anio").select(
        "anio", "ocupacion", "n", F.round("p95", 9).alias("p95"), F.round("indice_congestion", 9).alias("indice"))


def _repaired(f: Fixture):
    broken = f.cleaned.withColumn("indice_congestion", F.lit(0.0))
    df = congestion.repair_index(broken)
    return _counted(df.select("ocupacion", F.round("indice_congestion", 9).alias("indice")), "ocupacion", "indice")


def _sql_scan(f: Fixture):
    return readers.run_sql(f.spark, "SELECT * FROM {incidentes} WHERE gravedad = 'Leve' ORDER BY fecha_incidente",
                           incidentes=f.incidentes)


def _catalogue(f: Fixture):
    """One table from its path, one from a loader since its path does not exist, one with narrow types and an index of zeros."""
    paths = {n: f.folder(n) for n in ("incidentes", "trafico")} | {"coordenadas": f.folder("falta")}
    writers.write_parquet(f.incidentes.withColumn("velocidad_promedio", F.col("velocidad_promedio").cast("float")), paths["incidentes"])
    narrow = cleaning.narrow_types(f.trafico).withColumn("indice_congestion", F.lit(0).cast("float"))
    writers.write_parquet(narrow, paths["trafico"])
    tables = catalog.open_tables(f.spark, paths, {"coordenadas": lambda: f.coordenadas})
    catalog.register_views(tables, prefix="cat_")
    return f.spark.sql("""SELECT 'trafico' AS tabla, COUNT(*) AS filas, ROUND(SUM(indice_congestion), 6) AS medida, typeof(ANY_VALUE(hora)) AS tipo FROM cat_trafico
                          UNION ALL SELECT 'incidentes', COUNT(*), SUM(velocidad_promedio), typeof(ANY_VALUE(velocidad_promedio)) FROM cat_incidentes
                          UNION ALL SELECT 'coordenadas', COUNT(*), ROUND(SUM(latitud), 6), typeof(ANY_VALUE(latitud)) FROM cat_coordenadas""")


def _located(df):
    return df.select("corredor", "comuna", F.round("latitud", 9).alias("latitud"), F.round("longitud", 9).alias("longitud"))


def _located_sql(table: str) -> str:
    return f"SELECT corredor, comuna, ROUND(latitud, 9) AS latitud, ROUND(longitud, 9) AS longitud FROM {table}"


ENTRIES = {
    # Sources and sinks
    "s1_discover_inputs": Entry(_discovered, "SELECT anio_carpeta AS anio, 1 AS archivos, COUNT(*) AS filas FROM trafico_raw GROUP BY anio_carpeta"),
    "s2_positional_read": Entry(
        _positional,
        "SELECT anio_carpeta, " + ", ".join(RAW_COLUMNS[:22]) + ", " + ", ".join(f"NULL::VARCHAR AS {c}" for c in RAW_COLUMNS[22:]) + ", COUNT(*) AS n FROM leido GROUP BY ALL"),
    "s3_header_read": Entry(
        _by_header,
        f"""SELECT anio_carpeta, {_LANDED}, COUNT(*) AS n FROM (SELECT * FROM leido UNION ALL
            SELECT * REPLACE (NULL::VARCHAR AS intensidad_veh_h) FROM leido) r GROUP BY ALL"""),
    "s4_row_mode_read": Entry(
        _row_mode,
        f"""SELECT anio_carpeta AS anio, {month_no('mes')} AS mes_num, COALESCE(trim(mes), '') AS mes, {whole('hora')} AS hora,
            upper(COALESCE(trim(sentido), '')) AS sentido, lower(COALESCE(trim(operacion), '')) AS operacion, COUNT(*) AS n FROM crudo GROUP BY ALL"""),
    "s5_parquet_scan": Entry(
        lambda f: _counted(readers.read_table(f.spark, f"{f.sf_dir}/orders.parquet"), "o_orderstatus", "o_orderpriority"),
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL"),
    "s6_column_scan": Entry(
        lambda f: _counted(readers.read_table(f.spark, f"{f.sf_dir}/lineitem.parquet", ["l_returnflag", "l_linestatus"]),
                           "l_returnflag", "l_linestatus"),
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ALL"),
    "s7_sql_scan": Entry(_sql_scan, "SELECT * FROM incidentes WHERE gravedad = 'Leve'"),
    "s8_table_export": Entry(
        _export, "SELECT id, " + ", ".join({"hora": "hora::TINYINT AS hora", "dia_num": "dia_num::TINYINT AS dia_num", "mes_num": "mes_num::TINYINT AS mes_num",
                                            "anio": "anio::SMALLINT AS anio"}.get(c, c) for c in _EXPORTED)
        + ", COUNT(*) AS n FROM trafico WHERE id % 5 = 0 GROUP BY ALL"),
    "s9_csv_sink": Entry(_csv_sink, _CSV_ROWS_SQL),
    "s10_parquet_by_year": Entry(_yearly_sink, "SELECT *, COUNT(*) AS n FROM trafico GROUP BY ALL"),
    "s10_curve_cells": Entry(_curve_cells, _curve_sql()),
    "s10_clustered_filters": Entry(
        _clustered_filters, "SELECT anio, COUNT(*) AS filas, " + ", ".join(
            f"COUNT(*) FILTER ({c}) AS {n}, ROUND(SUM(velocidad_kmh) FILTER ({c}), 6) AS suma_{n}" for n, c in _CHOICES.items()) + " FROM trafico GROUP BY anio"),
    "s11_unified_parquet": Entry(_unified_sink, "SELECT *, COUNT(*) AS n FROM limpio GROUP BY ALL"),
    "s12_s13_append_and_reload": Entry(
        _append_and_reload, "SELECT *, COUNT(*) AS n FROM incidentes GROUP BY ALL"),
    "s13_reload_without_gap": Entry(
        _reloaded, """SELECT anio, COUNT(*) AS antes, CASE WHEN anio >= 1995 THEN COUNT(*) END AS ahora FROM incidentes GROUP BY anio"""),
    "s14_summary_table": Entry(
        _summary_table,
        """SELECT corredor, comuna, COUNT(*) AS total_registros, AVG(velocidad_kmh) AS velocidad_promedio, AVG(intensidad_veh_h) AS intensidad_promedio,
           AVG(ocupacion) AS ocupacion_promedio FROM trafico GROUP BY corredor, comuna"""),
    "s17_load_audit": Entry(
        lambda f: writers.load_audit(trafico=f.trafico, incidentes=f.incidentes),
        """SELECT 'trafico' AS tabla, anio, COUNT(*) AS filas FROM trafico GROUP BY anio
           UNION ALL SELECT 'incidentes', anio, COUNT(*) FROM incidentes GROUP BY anio"""),
    "s18_catalog": Entry(
        _catalogue,
        """SELECT 'trafico' AS tabla, COUNT(*) AS filas, ROUND(SUM(CASE WHEN ocupacion IS NOT NULL THEN
               greatest(0.0, least(1.0, ocupacion / (SELECT MAX(ocupacion) FROM trafico))) END), 6) AS medida, 'int' AS tipo FROM trafico
           UNION ALL SELECT 'incidentes', COUNT(*), SUM(velocidad_promedio), 'double' FROM incidentes
           UNION ALL SELECT 'coordenadas', COUNT(*), ROUND(SUM(latitud), 6), 'double' FROM coordenadas"""),
    "etl_traffic_table": Entry(
        lambda f: _by_year(f.spark.read.parquet(_built(f))), f"SELECT anio, {_BY_YEAR} FROM trafico GROUP BY anio"),
    "etl_batch_job": Entry(
        _batch_etl,
        f"""SELECT {_LOADED}, ROUND(CASE WHEN COALESCE(p95, 0) > 0 THEN CASE WHEN ocupacion IS NULL THEN NULL ELSE greatest(0.0, least(1.0, ocupacion / p95)) END
            ELSE 0.0 END, 6) AS indice, COUNT(*) AS n FROM limpio LEFT JOIN p95_limpio USING (anio) GROUP BY ALL"""),
    # Cleaning and derived columns
    "c1_text_clean": Entry(
        _mapped("corredor", limpio=text.clean_cell), _mapped_sql("corredor", limpio="COALESCE(trim(corredor), '')")),
    "c2_hour_parse": Entry(_mapped("hora", hora=numbers.to_int), _mapped_sql("hora", hora=whole("hora"))),
    "c3_month_number": Entry(_mapped("mes", mes_num=dates.month_number), _mapped_sql("mes", mes_num=month_no("mes"))),
    "c4_case_rules": Entry(
        lambda f: _counted(cleaning.clean_for_csv(readers.drop_empty_rows(f.raw)), "corredor", "sentido", "operacion"),
        f"""SELECT {title("COALESCE(trim(corredor), '')")} AS corredor, upper(COALESCE(trim(sentido), '')) AS sentido,
            lower(COALESCE(trim(operacion), '')) AS operacion, COUNT(*) AS n FROM crudo GROUP BY ALL"""),
    "c5_drop_empty_rows": Entry(
        lambda f: readers.drop_empty_rows(f.raw).groupBy("anio_carpeta").agg(F.count("*").alias("filas")),
        "SELECT anio_carpeta, COUNT(*) AS filas FROM crudo GROUP BY anio_carpeta"),
    "c6_numeric_coercion": Entry(
        lambda f: _counted(f.raw.select(*[numbers.to_number(F.col(c)).alias(c) for c in cleaning.MEASURES]), *cleaning.MEASURES),
        "SELECT " + ", ".join(f"{num(c)} AS {c}" for c in cleaning.MEASURES) + ", COUNT(*) AS n FROM trafico_raw GROUP BY ALL"),
    "c7_vehicle_classes": Entry(
        lambda f: _counted(f.cleaned, *cleaning.VEHICLE_CLASSES),
        "SELECT " + ", ".join(cleaning.VEHICLE_CLASSES) + ", COUNT(*) AS n FROM limpio GROUP BY ALL"),
    "c8_hour_year_day_month": Entry(
        lambda f: _counted(f.cleaned, "hora", "anio", "dia_num", "mes_num"),
        "SELECT hora, anio, dia_num, mes_num, COUNT(*) AS n FROM limpio GROUP BY ALL"),
    "c9_date_coercion": Entry(
        lambda f: _counted(f.cleaned, "fecha_trafico", "fecha"), "SELECT fecha_trafico, fecha, COUNT(*) AS n FROM limpio GROUP BY ALL"),
    "c10_text_normalisation": Entry(
        lambda f: _counted(cleaning.clean(readers.drop_empty_rows(f.raw), null_text="pandas"), *_TEXT_COLUMNS, "periodo_dia"),
        "SELECT " + ", ".join(f"COALESCE({title(f'trim({c})')}, 'Nan') AS {c}" for c in ("carril", "corredor", "comuna", "dia_semana", "mes"))
        + f""", COALESCE(upper(trim(sentido)), 'NAN') AS sentido, COALESCE(lower(trim(operacion)), 'nan') AS operacion,
            COALESCE(trim(tipo_subsistema), 'nan') AS tipo_subsistema, identificador_fv, COALESCE({period('entera')}, 'nan') AS periodo_dia, COUNT(*) AS n
            FROM (SELECT *, {whole('hora')} AS entera FROM crudo) c GROUP BY ALL"""),
    "c11_text_normalisation_empty": Entry(
        lambda f: _counted(cleaning.clean(readers.drop_empty_rows(f.raw), null_text="empty"), *_TEXT_COLUMNS, "periodo_dia"),
        "SELECT " + ", ".join(f"COALESCE({c}, '') AS {c}" for c in _TEXT_COLUMNS)
        + ", COALESCE(periodo_dia, 'nan') AS periodo_dia, COUNT(*) AS n FROM limpio GROUP BY ALL"),
    "c12_c13_period_and_rush_hour": Entry(
        lambda f: _counted(f.cleaned, "hora", "periodo_dia", "es_hora_pico"),
        f"SELECT hora, {period('hora')} AS periodo_dia, {rush('hora')} AS es_hora_pico, COUNT(*) AS n FROM limpio GROUP BY ALL"),
    "c14_index_p95": Entry(
        _index("p95_year"),
        """SELECT anio, ocupacion, ROUND(CASE WHEN COALESCE(p95, 0) > 0 THEN CASE WHEN ocupacion IS NOT NULL THEN
           greatest(0.0, least(1.0, ocupacion / p95)) END ELSE 0.0 END, 9) AS indice, COUNT(*) AS n FROM limpio LEFT JOIN p95_limpio USING (anio) GROUP BY ALL"""),
    "c14_yearly_p95": Entry(
        lambda f: congestion.yearly_p95(f.trafico).select("anio", F.round("p95", 9).alias("p95")), "SELECT anio, ROUND(p95, 9) AS p95 FROM p95"),
    "c14_yearly_p95_approximate": Entry(
        lambda f: congestion.yearly_p95(f.trafico, approximate=True),
        "SELECT anio, quantile_disc(ocupacion, 0.95) AS p95 FROM trafico GROUP BY anio"),
    "c14_running_index": Entry(
        _running,
        """SELECT anio, ocupacion, COUNT(*) AS n, ROUND(ANY_VALUE(p95), 9) AS p95, ROUND(ANY_VALUE(indice_congestion), 9) AS indice
           FROM indexado JOIN (SELECT anio, p95 AS p95 FROM p95) d USING (anio) GROUP BY anio, ocupacion"""),
    "c15_index_max_valid": Entry(
        _index("max_valid"),
        """SELECT anio, ocupacion, ROUND(CASE WHEN ocupacion IS NOT NULL THEN least(1.0, ocupacion / (SELECT COALESCE(MAX(ocupacion), 1)
           FROM limpio WHERE ocupacion > 0 AND ocupacion < 1000)) END, 9) AS indice, COUNT(*) AS n FROM limpio GROUP BY ALL"""),
    "c16_index_repair": Entry(
        _repaired,
        """SELECT ocupacion, ROUND(CASE WHEN ocupacion IS NOT NULL THEN greatest(0.0, least(1.0, ocupacion / (SELECT MAX(ocupacion) FROM limpio))) END, 9)
           AS indice, COUNT(*) AS n FROM limpio GROUP BY ALL"""),
    "c17_narrow_types": Entry(
        lambda f: _counted(cleaning.narrow_types(f.cleaned), "hora", "dia_num", "mes_num", "anio", "velocidad_kmh"),
        """SELECT CAST(hora AS TINYINT) AS hora, CAST(dia_num AS TINYINT) AS dia_num, CAST(mes_num AS TINYINT) AS mes_num,
           CAST(anio AS SMALLINT) AS anio, CAST(velocidad_kmh AS FLOAT) AS velocidad_kmh, COUNT(*) AS n FROM limpio GROUP BY ALL"""),
    "c18_random_sample": Entry(_sampled, _SAMPLE_SQL),
    "c19_modulus_sample": Entry(
        lambda f: sampling.modulus_sample(f.trafico, 0.2).select("id", "fecha", "hora", "corredor", "velocidad_kmh"),
        "SELECT id, fecha, hora, corredor, velocidad_kmh FROM trafico WHERE id % 5 = 0"),
    "c20_incident_coercion": Entry(
        lambda f: _counted(cleaning.clean_incidents(f.incidentes.withColumns({
            "fecha_incidente": F.when(F.col("id") % 7 == 0, "ayer").otherwise(F.col("fecha_incidente").cast("string")),
            "conteo_vehicular": F.when(F.col("id") % 11 == 0, "?").otherwise(F.col("conteo_vehicular").cast("string")),
            "velocidad_promedio": F.when(F.col("id") % 13 == 0, "nan").otherwise(F.col("velocidad_promedio").cast("string")),
        })), "fecha_incidente", "conteo_vehicular", "velocidad_promedio"),
        """SELECT CASE WHEN id % 7 <> 0 THEN fecha_incidente END AS fecha_incidente, CASE WHEN id % 11 = 0 THEN 0 ELSE conteo_vehicular END AS conteo_vehicular,
           CASE WHEN id % 13 <> 0 THEN velocidad_promedio END AS velocidad_promedio, COUNT(*) AS n FROM incidentes GROUP BY ALL"""),
    "c21_time_index": Entry(
        lambda f: forecast.monthly_points(f.cleaned),
        """SELECT anio, mes_num, AVG(intensidad_veh_h) AS intensidad, (anio - (SELECT MIN(anio) FROM limpio)) * 12 + mes_num AS t FROM limpio
           GROUP BY anio, mes_num HAVING AVG(intensidad_veh_h) IS NOT NULL"""),
    "c22_percent_columns": Entry(
        lambda f: f.trafico.groupBy("comuna").agg(
            numbers.percent(F.count_if("es_hora_pico"), F.count("*")).alias("pct_pico"),
            numbers.percent(F.count("ocupacion"), F.count("*"), 2).alias("pct_con_ocupacion")),
        """SELECT comuna, ROUND(CAST(COUNT(*) FILTER (WHERE es_hora_pico) AS DOUBLE) * 100 / COUNT(*), 1) AS pct_pico,
           ROUND(CAST(COUNT(ocupacion) AS DOUBLE) * 100 / COUNT(*), 2) AS pct_con_ocupacion FROM trafico GROUP BY comuna"""),
    # Geo
    "g1_first_coordinates": Entry(
        lambda f: geo.first_coordinates(f.cleaned), "SELECT corredor, comuna, latitud, longitud FROM pares"),
    "g2_grid_to_degrees": Entry(
        lambda f: geo.convert(geo.first_coordinates(f.cleaned)), "SELECT corredor, comuna, latitud, longitud FROM convertido"),
    "g3_district_fallback": Entry(
        lambda f: geo.fill_from_district(geo.convert(geo.first_coordinates(f.cleaned))),
        "SELECT corredor, comuna, latitud, longitud FROM por_barrio"),
    "g4_g5_corridor_and_city_fallback": Entry(lambda f: _located(f.located), _located_sql("ubicado")),
    "g6_inside_city": Entry(
        lambda f: _located(filters.inside_city(f.located)),
        _located_sql("ubicado") + " WHERE latitud BETWEEN 6.0 AND 6.5 AND longitud BETWEEN -75.8 AND -75.3"),
    # Predicates
    "p2_named_corridors": Entry(
        lambda f: _counted(filters.named_corridors(f.trafico), "corredor"),
        "SELECT corredor, COUNT(*) AS n FROM trafico WHERE corredor NOT IN ('', 'Nan', 'None') GROUP BY corredor"),
    "p3_weekday_whitelist": Entry(
        lambda f: _counted(f.trafico.where(F.col("dia_semana").isin(*dates.WEEKDAYS[:5])), "dia_semana"),
        "SELECT dia_semana, COUNT(*) AS n FROM trafico WHERE dia_semana IN ('Lunes','Martes','Miercoles','Jueves','Viernes') GROUP BY 1"),
    "p4_speed_thresholds": Entry(
        lambda f: f.trafico.groupBy("hora").agg(tr.slower_than(F.col("velocidad_kmh"), 30).alias("bajo_30"),
                                                tr.slower_than(F.col("velocidad_kmh"), 20).alias("bajo_20")),
        """SELECT hora, CAST(SUM(CASE WHEN velocidad_kmh < 30 THEN 1 ELSE 0 END) AS BIGINT) AS bajo_30,
           CAST(SUM(CASE WHEN velocidad_kmh < 20 THEN 1 ELSE 0 END) AS BIGINT) AS bajo_20 FROM trafico GROUP BY hora"""),
    "p5_group_filter": Entry(
        lambda f: f.trafico.groupBy("corredor", "comuna").agg(F.count("*").alias("total")).where(F.col("total") > 100),
        "SELECT corredor, comuna, COUNT(*) AS total FROM trafico GROUP BY corredor, comuna HAVING total > 100"),
    "p7_finite_rows": Entry(
        lambda f: filters.finite_only(f.cleaned, "velocidad_kmh", "ocupacion").groupBy("anio").agg(F.count("*").alias("filas")),
        "SELECT anio, COUNT(*) AS filas FROM limpio WHERE isfinite(velocidad_kmh) AND isfinite(ocupacion) GROUP BY anio"),
    "p8_incident_filter": Entry(
        lambda f: dashboard.top_incident_places(filters.filter_incidents(f.incidentes, ("Accidente", "Obra"), ("Crítico",))),
        """SELECT ubicacion, COUNT(id_incidente) AS total, AVG(conteo_vehicular) AS vehiculos FROM incidentes
           WHERE tipo_evento IN ('Accidente', 'Obra') AND gravedad IN ('Crítico') GROUP BY ubicacion ORDER BY total DESC, ubicacion LIMIT 15"""),
    "p10_valid_occupancy": Entry(
        lambda f: f.cleaned.where((F.col("ocupacion") > 0) & (F.col("ocupacion") < 1000)).groupBy("anio").agg(
            F.count("*").alias("filas"), F.max("ocupacion").alias("mayor")),
        "SELECT anio, COUNT(*) AS filas, MAX(ocupacion) AS mayor FROM limpio WHERE ocupacion > 0 AND ocupacion < 1000 GROUP BY anio"),
    "p12_fill_zero": Entry(
        lambda f: f.trafico.select("corredor", "intensidad_veh_h", "ocupacion").na.fill(0.0).groupBy("corredor").agg(
            F.avg("intensidad_veh_h").alias("intensidad"), F.avg("ocupacion").alias("ocupacion")),
        """SELECT corredor, AVG(COALESCE(intensidad_veh_h, 0)) AS intensidad, AVG(COALESCE(ocupacion, 0)) AS ocupacion FROM trafico GROUP BY corredor"""),
    # Joins and aggregates that no named query shows on its own
    "j3_point_per_corridor": Entry(
        lambda f: geo.one_point_per_corridor(f.coordenadas), "SELECT clave, corredor, latitud, longitud FROM puntos"),
    "j_folded_key_join": Entry(
        _folded_join, """SELECT gravedad, upper(translate(gravedad, 'áéíóú', 'aeiou')) AS nivel, COUNT(*) AS n FROM incidentes
                         WHERE gravedad IS NOT NULL GROUP BY 1, 2"""),
    "a2_a5_counts_and_distinct": Entry(
        lambda f: f.trafico.groupBy("anio").agg(
            F.count("*").alias("filas"), F.count("intensidad_veh_h").alias("con_intensidad"), F.countDistinct("corredor").alias("corredores")),
        """SELECT anio, COUNT(*) AS filas, COUNT(intensidad_veh_h) AS con_intensidad, COUNT(DISTINCT corredor) AS corredores FROM trafico GROUP BY anio"""),
    "a8_quantiles": Entry(
        lambda f: exact_quantiles(f.trafico, "anio", "intensidad_veh_h", (0.05, 0.5, 0.95)).withColumn("valor", F.round("valor", 6)),
        " UNION ALL ".join(
            f"SELECT anio, CAST({q} AS DOUBLE) AS q, ROUND(quantile_cont(intensidad_veh_h, {q}), 6) AS valor FROM trafico GROUP BY anio"
            for q in (0.05, 0.5, 0.95))),
    "a10_value_counts": Entry(
        lambda f: profile.value_counts(f.cleaned, "tipo_subsistema"),
        "SELECT tipo_subsistema, COUNT(*) AS total FROM limpio WHERE tipo_subsistema IS NOT NULL GROUP BY 1"),
    "a15_union_of_years": Entry(
        lambda f: _by_year(etl.union_years(f.trafico.where(F.col("anio") <= 1997), f.trafico.where(F.col("anio") > 1997).drop("carril"))),
        f"SELECT anio, {_BY_YEAR} FROM trafico GROUP BY anio"),
    "n1_column_types": Entry(
        lambda f: profile.column_types(f.incidentes),
        """SELECT CAST(orden AS INTEGER) AS orden, columna, tipo FROM (VALUES (1, 'id', 'bigint'), (2, 'id_incidente', 'string'),
           (3, 'fecha_incidente', 'timestamp_ntz'), (4, 'ubicacion', 'string'), (5, 'tipo_evento', 'string'), (6, 'gravedad', 'string'),
           (7, 'conteo_vehicular', 'int'), (8, 'velocidad_promedio', 'double'), (9, 'anio', 'int')) t(orden, columna, tipo)"""),
    "t2_t3_ordinals": Entry(
        lambda f: _counted(f.cleaned.select(
            "dia_semana", tr.field_order(F.col("dia_semana"), dates.WEEKDAYS).alias("dia_orden"),
            "mes", tr.field_order(F.col("mes"), dates.MONTHS).alias("mes_orden")), "dia_semana", "dia_orden", "mes", "mes_orden"),
        f"""SELECT dia_semana, {position('dia_semana', dates.WEEKDAYS)} AS dia_orden, mes, {position('mes', dates.MONTHS)} AS mes_orden,
            COUNT(*) AS n FROM limpio GROUP BY ALL"""),
    "f_date_functions": Entry(
        lambda f: _counted(f.incidentes.select(
            F.hour("fecha_incidente").alias("hora"), F.month("fecha_incidente").alias("mes"), F.year("fecha_incidente").alias("anio"),
            F.last_day("fecha_incidente").alias("fin_de_mes"),
            dates.month_start(F.year("fecha_incidente"), F.month("fecha_incidente")).alias("inicio_de_mes")),
            "hora", "mes", "anio", "fin_de_mes", "inicio_de_mes"),
        """SELECT CAST(hour(fecha_incidente) AS INTEGER) AS hora, CAST(month(fecha_incidente) AS INTEGER) AS mes, CAST(year(fecha_incidente) AS INTEGER) AS anio,
           last_day(CAST(fecha_incidente AS DATE)) AS fin_de_mes, CAST(date_trunc('month', fecha_incidente) AS DATE) AS inicio_de_mes, COUNT(*) AS n
           FROM incidentes GROUP BY ALL"""),
    # Incremental ingest
    "r1_r2_resumable_ingest": Entry(
        _ingest, f"SELECT {_LOADED}, COUNT(*) AS n FROM limpio GROUP BY ALL"),
    "r1_ledger_of_files": Entry(
        _ledger, "SELECT anio_carpeta AS anio, 'cargado' AS estado, 1 AS intento, COUNT(*) AS filas FROM crudo GROUP BY anio_carpeta"),
    "r3_csv_stream": Entry(_csv_ingest, _CSV_ROWS_SQL),
    "r4_rejected_rows": Entry(
        _rejects,
        f"""SELECT {_LINE} || CASE trim(carril) WHEN 'carril 3' THEN ',sobra' ELSE ',"abierta' END AS registro, COUNT(*) AS n
            FROM crudo WHERE trim(carril) IN ('carril 3', 'carril 4') GROUP BY 1
            UNION ALL SELECT NULL, COUNT(*) FROM crudo WHERE trim(carril) NOT IN ('carril 3', 'carril 4')"""),
}
