"""Reading and writing files, batch ETL, and incremental ingest."""

from __future__ import annotations

import csv
import gzip
import os
import time

import pytest
from pyspark.sql import functions as F

from calzada.operators.profile import schema_table
from calzada.plans import etl
from calzada.sources import readers, writers
from calzada.sources.schemas import RAW_COLUMNS
from calzada.sources.workspace import new_folder
from calzada.streaming import ingest


def line(**cells):
    return ",".join(cells.get(c, "") for c in RAW_COLUMNS)


def put(path, *lines, header=",".join(RAW_COLUMNS)):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")


@pytest.fixture
def base(tmp_path):
    """Two year folders with a file of the same name, plus files to leave alone."""
    put(tmp_path / "in/2019/a.csv", line(corredor="calle 10a", hora="7.9", ocupacion="5", mes="enero"), line())
    put(tmp_path / "in/2020/a.csv", line(corredor="ÑUTIBARA", hora="x", ocupacion="10", mes="mayo", anio="1999"))
    put(tmp_path / "in/2020/B.CSV", line(corredor="av 80", hora="18", ocupacion="20"))
    put(tmp_path / "in/2020/~$a.csv", "basura")
    put(tmp_path / "in/notas/a.csv", "basura")
    return tmp_path


def test_discovery(spark, base):
    got = readers.discover_inputs(spark, str(base / "in"))
    assert [(r.anio, r.archivo) for r in got.collect()] == [(2019, "a.csv"), (2020, "B.CSV"), (2020, "a.csv")]


def test_positional_read_pads_and_takes_the_folder_year(spark, base):
    put(base / "corto/2021/c.csv", "c1,2021-01-01 00:00:00", header="Uno,Dos")
    df = readers.read_positional(spark, str(base / "corto/2021"), n_columns=2)
    r = df.first()
    assert df.columns == [*RAW_COLUMNS, "anio_carpeta"]
    assert (r.carril, r.fecha_trafico, r.codigo_comuna, r.anio_carpeta) == ("c1", "2021-01-01 00:00:00", None, 2021)


def test_cells_past_the_known_columns_are_dropped(spark, base):
    put(base / "ancho/2021/c.csv", line(carril="c1", codigo_comuna="9") + ",sobra,más", header=",".join([*RAW_COLUMNS, "x", "y"]))
    df = readers.read_positional(spark, str(base / "ancho/2021"))
    r = df.first()
    assert df.columns == [*RAW_COLUMNS, "anio_carpeta"] and (r.carril, r.codigo_comuna) == ("c1", "9")


def test_header_layouts_are_merged(spark, base):
    files = []
    for i, header in enumerate(["Corredor,Intensidad (Veh/h)", "Intensidad,Corredor", "Corredor,otra", "Corredor,Intensidad (Veh/h)"]):
        put(base / f"h/2020/f{i}.csv", f"{i},9" if i != 1 else "9,1", header=header)
        files.append(str(base / f"h/2020/f{i}.csv"))
    got = {r.corredor: r.intensidad_veh_h for r in readers.read_by_header(spark, files).collect()}
    assert got == {"0": "9", "1": "9", "2": None, "3": "9"}
    with pytest.raises(ValueError):
        readers.read_by_header(spark, [])


def test_batch_etl(spark, base):
    summary = etl.parquet_job(spark, str(base / "in/20*"), str(base / "out"), str(base / "todo")).first()
    assert (summary.registros, summary.anios, summary.corredores) == (3, 3, 3)
    rows = {r.corredor: r for r in spark.read.parquet(str(base / "todo")).collect()}
    assert (rows["Calle 10A"].hora, rows["Calle 10A"].anio, rows["Calle 10A"].indice_congestion) == (7, 2019, 1.0)
    assert (rows["Ñutibara"].anio, rows["Ñutibara"].mes_num) == (1999, 5)
    assert rows["Av 80"].periodo_dia == "Noche"


def test_runs_over_other_folders_keep_stray_years(spark, base):
    put(base / "in/2019/b.csv", line(corredor="uno", hora="3", anio="2019"))
    put(base / "in/2020/c.csv", line(corredor="dos", hora="3", anio="2019"))
    for year in ("2019", "2020"):
        etl.parquet_job(spark, str(base / f"in/{year}"), str(base / "out"), str(base / "todo"))
    rows = spark.read.parquet(str(base / "out")).collect()
    assert {"Uno", "Dos", "Calle 10A"} <= {r.corredor for r in rows} and len(rows) == 5
    assert "Uno" not in {r.corredor for r in spark.read.parquet(str(base / "todo")).collect()}


def test_only_inputs_are_read(spark, base):
    for name in ("in/2019/notas.txt", "in/2019/~$a.csv", "viejo/x.csv"):
        put(base / name, line(corredor="basura", hora="1"))
    put(base / "in/20190101120000/z.csv", line(corredor="basura", hora="1"))
    rows = readers.read_positional(spark, [str(base / "in"), str(base / "viejo")]).collect()
    assert rows and "basura" not in {r.corredor for r in rows}
    assert readers.discover_inputs(spark, str(base / "in")).count() >= 3


def test_quotes_and_line_breaks_survive(spark, tmp_path):
    cells = ['Calle "A", 5', 'dos\nlineas', "a,b", '"', "simple"]
    df = spark.createDataFrame([(c, "2020") for c in cells], "corredor string, anio_carpeta string")
    full = readers.pad_columns(df)
    writers.write_csv_by_year(full, str(tmp_path / "t"), year="anio_carpeta")
    back = readers.read_positional(spark, str(tmp_path / "t"), multi_line=True)
    assert sorted(r.corredor for r in back.collect()) == sorted(cells)
    with_csv = [row[list(readers.RAW_COLUMNS).index("corredor")] for f in (tmp_path / "t").rglob("*.csv") for row in list(csv.reader(f.open(newline="")))[1:]]
    assert sorted(with_csv) == sorted(cells)


def test_of_repeated_headers_the_first_counts(spark, base):
    put(base / "h/2020/f.csv", "x,y,z,u,v", header="Carril,Comuna,Comuna,Hora,carril")
    r = readers.read_by_header(spark, [str(base / "h/2020/f.csv")]).first()
    assert (r.carril, r.comuna, r.hora) == ("x", "y", "u")


def test_short_rows_are_padded_and_damaged_files_tried_again(spark, base):
    put(base / "in/2020/corta.csv", ",".join(line(corredor="corta", hora="4").split(",")[:22]))
    packed = gzip.compress("\n".join(["h"] + [line(corredor=f"r{i}", hora="5") for i in range(20_000)]).encode(), mtime=0)
    (base / "in/2020/rota.csv.gz").write_bytes(packed[: len(packed) // 2])
    source, target, log = str(base / "in/20*"), str(base / "t"), str(base / "log")
    ingest.ingest_new_files(spark, source, target, log)
    names = {r.corredor for r in ingest.ingested(spark, target).collect()}
    assert {"Corta", "Calle 10A"} <= names and "R7" not in names
    assert ingest.rejected(spark, target).count() == 0
    assert [r.archivo.endswith("rota.csv.gz") for r in ingest.failed_files(spark, target).collect()] == [True]
    before = ingest.ingested(spark, target).count()
    ingest.ingest_new_files(spark, source, target, log)
    assert ingest.ingested(spark, target).count() == before and ingest.failed_files(spark, target).count() == 1
    (base / "in/2020/rota.csv.gz").write_bytes(packed)
    assert ingest.ingest_new_files(spark, source, target, log)
    assert ingest.ingested(spark, target).count() == before + 20_000 and ingest.failed_files(spark, target).count() == 0


def test_rewriting_a_year_leaves_the_others(spark, tmp_path):
    df = spark.createDataFrame([(2019, "a"), (2020, "b")], "anio int, corredor string")
    writers.write_parquet_by_year(df, str(tmp_path / "t"))
    writers.write_parquet_by_year(spark.createDataFrame([(2020, "c")], df.schema), str(tmp_path / "t"), balanced=True)
    assert sorted((r.anio, r.corredor) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(2019, "a"), (2020, "c")]


def test_a_hot_year_is_spread_over_files(spark, tmp_path):
    df = spark.range(0, 200_000, 1, 4).withColumn("anio", F.lit(2020)).unionByName(spark.createDataFrame([(1, 2019)], "id long, anio int"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        writers.write_parquet_by_year(df, str(tmp_path / "t"), balanced=True, sort_by=None)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_001
    assert len(list((tmp_path / "t/anio=2020").glob("*.parquet"))) > 1


def test_append_reload_export_and_audit(spark, tmp_path):
    df, path = spark.createDataFrame([(2019, 1), (2020, 2)], "anio int, id int"), str(tmp_path / "t")
    writers.append_rows(df, path)
    writers.append_rows(df, path)
    assert spark.read.parquet(path).count() == 4
    writers.reload_table(df, path)
    assert spark.read.parquet(path).count() == 2
    assert writers.export_table(df, str(tmp_path / "e"), expected_rows=2).count() == 2
    with pytest.raises(RuntimeError):
        writers.export_table(df, str(tmp_path / "e2"), expected_rows=3)
    assert {tuple(r) for r in writers.load_audit(t=df).collect()} == {("t", 2019, 1), ("t", 2020, 1)}


def test_summary_kept_as_a_table(spark, tmp_path):
    df = spark.createDataFrame([(2019, 1)], "anio int, id int")
    for _ in range(2):  # a second run replaces the first
        writers.create_table_as(df, "resumen_prueba", str(tmp_path / "tabla"))
    assert spark.table("resumen_prueba").count() == 1
    spark.sql("DROP TABLE resumen_prueba")


def test_traffic_table_in_one_go(spark, base):
    raw = readers.drop_empty_rows(readers.read_positional(spark, [str(base / "in/2019"), str(base / "in/2020")]))
    rows = {r.corredor: r for r in etl.traffic_table(raw, method="max_valid", null_text="empty").collect()}
    assert rows["Av 80"].indice_congestion == 1.0 and rows["Calle 10A"].indice_congestion == 0.25 and rows["Av 80"].comuna == ""
    assert etl.traffic_table(raw, fraction=1.0).count() == 3
    assert dict(schema_table(etl.traffic_table(raw, method="max")))["indice_congestion"] == "double"


def test_jdbc_reader_is_partitioned():
    got = readers.jdbc_options("jdbc:x", "trafico", partitionColumn="id", lowerBound=1, upperBound=9, numPartitions=4)
    assert got == {"url": "jdbc:x", "dbtable": "trafico", "partitionColumn": "id", "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}


def test_ingest_resumes(spark, base):
    source, target, log = str(base / "in/20*"), str(base / "t"), str(base / "log")
    assert ingest.ingest_new_files(spark, source, target, log, files_per_batch=1)
    first = ingest.ingested(spark, target)
    assert sorted(r.corredor for r in first.collect()) == ["Av 80", "Calle 10A", "Ñutibara"]  # equal names, two folders
    assert not ingest.ingest_new_files(spark, source, target, log)
    assert ingest.ingested(spark, target).count() == 3
    put(base / "in/2021/a.csv", line(corredor="nueva", hora="1"))
    ingest.ingest_new_files(spark, str(base / "in/20*"), target, log)
    assert ingest.ingested(spark, target).count() == 4
    assert {r.anio for r in ingest.ingested(spark, target).collect()} == {2019, 1999, 2020, 2021}


def test_a_repeated_batch_replaces_its_rows(spark, base):
    write = ingest._write_batch(str(base / "t"))
    batch = readers.read_positional(spark, str(base / "in/2020")).withColumn(ingest.REJECTED, F.lit(None).cast("string"))
    write(batch, 0)
    write(batch, 0)
    assert ingest.ingested(spark, str(base / "t")).count() == 2


def test_bad_rows_and_bad_files_do_not_stop_the_load(spark, base):
    put(base / "in/2020/mala.csv", "demasiado," + line(corredor="x"), line(corredor="buena", hora="2"))
    with gzip.open(base / "in/2020/rota.csv.gz", "wb") as f:
        f.write(b"x" * 100_000)
    whole = (base / "in/2020/rota.csv.gz").read_bytes()
    (base / "in/2020/rota.csv.gz").write_bytes(whole[: len(whole) // 2])
    target = str(base / "t")
    ingest.ingest_new_files(spark, str(base / "in/20*"), target, str(base / "log"))
    assert "Buena" in {r.corredor for r in ingest.ingested(spark, target).collect()}
    lines = [r.registro for r in ingest.rejected(spark, target).collect()]
    assert any(x.startswith("demasiado") for x in lines)
    assert not any("demasiado" == r.carril for r in ingest.ingested(spark, target).collect())


def test_csv_stream(spark, base):
    source, target, log = str(base / "in/20*"), str(base / "csv"), str(base / "log")
    for _ in range(2):
        ingest.csv_stream(spark, source, target, log)
    got = spark.read.option("header", "true").csv(target)
    assert sorted((r.anio, r.hora, r.mes_num, r.corredor) for r in got.collect()) == [
        (2019, "7", "1", "Calle 10A"), (2020, "0", "5", "Ñutibara"), (2020, "18", "0", "Av 80")]


class Session:
    """Just the settings the workspace looks at."""

    def __init__(self, folder, master):
        self.conf, self.sparkContext, self.folder, self.master = self, self, folder, master

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


def test_workspace_uses_the_shared_folder():
    assert new_folder(Session("hdfs://nn/tmp/", "yarn"), "x").startswith("hdfs://nn/tmp/x-")
    assert new_folder(Session(None, "local[2]"), "x").count("x-") == 1
    with pytest.raises(RuntimeError):
        new_folder(Session(None, "yarn"), "x")


def test_written_tables_leave_no_shuffle_files(spark):
    import glob

    from calzada.sources import workspace

    def held():
        return {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}

    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    before, setting = held(), spark.conf.get(workspace.CLEANUP)
    rows = spark.range(10_000).repartition(5, "id")
    written, path = workspace.stored(rows, "t")
    assert written.count() == 10_000 and rows.count() == 10_000
    assert spark.conf.get(workspace.CLEANUP) == setting
    more = held() - before
    assert more  # a count leaves its shuffle behind
    workspace.materialise(spark.range(10_000).repartition(7, "id"), "t")
    time.sleep(2)
    assert not held() - before - more
    workspace.drop_folder(spark, path)
    assert not os.path.exists(path)


def test_stream_may_pack_its_cleaned_files(spark, base):
    target = str(base / "limpio")
    ingest.csv_stream(spark, str(base / "in/20*"), target, str(base / "log"), compression="gzip")
    files = [p.name for p in (base / "limpio").rglob("part-*")]
    assert files and all(n.endswith(".csv.gz") for n in files)
    rows = spark.read.option("header", "true").csv(target).collect()
    assert sorted(r.corredor for r in rows) == ["Av 80", "Calle 10A", "Ñutibara"]
