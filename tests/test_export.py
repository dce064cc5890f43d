"""Export by ranges, and header layouts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from calzada.sources import export, readers
from calzada.sources.schemas import RAW_COLUMNS


def table(spark):
    rng = random.Random(1)
    rows = [(rng.choice([5, 5, 5, rng.randint(-1_000, 1_000), None]), i % 24, i / 2, f"t{i % 7}") for i in range(3_000)]
    return spark.createDataFrame(rows, "id bigint, hora int, v double, s string"), rows


def contents(df):
    return sorted(map(str, df.select("id", "hora", F.col("v").cast("double"), "s").collect()))


def test_ranges_are_balanced_and_whole(spark, tmp_path):
    df, rows = table(spark)
    out = export.export_ranges(df, str(tmp_path / "t"), "id", chunks=6)
    assert contents(out) == contents(df)
    assert dict(out.dtypes) == {"id": "bigint", "hora": "tinyint", "v": "float", "s": "string"}
    plan = sorted(spark.read.parquet(str(tmp_path / "t_plan")).collect())
    cuts = [r.hasta for r in plan if r.hasta is not None]
    sizes = [0] * len(plan)
    for r in rows:
        sizes[export.place_of(cuts, r[0])] += 1
    assert [r.filas for r in plan] == sizes and sizes[0] == sum(r[0] is None for r in rows)
    # The key that half the rows share is one range; all others have about a sixth at most.
    assert sorted(sizes[1:])[-2] <= len(rows) / 6 * 1.1


def test_an_export_goes_on_where_it_was_ended(spark, tmp_path, monkeypatch):
    df, _ = table(spark)
    path = str(tmp_path / "t")
    calls = []
    real = export.exported

    class Ended(BaseException):
        pass

    append = type(df.write).parquet

    def ended(self, at, *args, **more):
        append(self, at, *args, **more)
        calls.append(at)
        if at == path and sum(c == path for c in calls) == 2:
            raise Ended

    monkeypatch.setattr(type(df.write), "parquet", ended)
    with pytest.raises(Ended):
        export.export_ranges(df, path, "id", chunks=6, chunks_per_job=2)
    half = {r.tramo for r in real(df, path).collect()}
    assert len(half) == 2  # the second pair is written, but was not counted
    monkeypatch.setattr(type(df.write), "parquet", append)
    before = {p: p.stat().st_mtime_ns for t in half for p in (tmp_path / f"t/tramo={t}").glob("*.parquet")}
    assert contents(export.export_ranges(df, path, "id", chunks=6, chunks_per_job=2)) == contents(df)
    assert all(p.stat().st_mtime_ns == was for p, was in before.items())
    assert contents(export.export_ranges(df, path, "id")) == contents(df)


def test_a_source_that_changes_is_noticed(spark, tmp_path):
    df, _ = table(spark)
    path = str(tmp_path / "t")
    export._plan(df, f"{path}_plan", "id", 4, True).count()
    with pytest.raises(RuntimeError):
        export.export_ranges(df.where("v < 700"), path, "id", 4)


def test_few_or_no_keys(spark, tmp_path):
    df, _ = table(spark)
    for name, part in (("uno", df.where("id = 5")), ("nulos", df.where("id IS NULL"))):
        assert contents(export.export_ranges(part, str(tmp_path / name), "id", 4)) == contents(part)


def test_many_layouts_take_one_job(spark, tmp_path):
    folder = tmp_path / "2020"
    folder.mkdir()
    headers = ["Corredor,Hora", "Hora,Corredor", '"Corredor","Intensidad (Veh/h)"']
    for i in range(60):
        (folder / f"f {i}%20[x].csv").write_text(f"{headers[i % 3]}\n{i},{i + 100}\n" * 1, encoding="utf-8")
    (folder / "vacio.csv").write_text("")
    files = sorted(str(p) for p in folder.iterdir())
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("cabeceras", "")
    layouts = readers.header_layouts(spark, files)
    jobs = len(tracker.getJobIdsForGroup("cabeceras"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(len(paths) for paths in layouts.values()) == [20, 20, 20]
    assert jobs < 10  # listing, scan and grouping, however many files there are
    got = readers.read_by_header(spark, files)
    assert got.columns == [*RAW_COLUMNS, "anio_carpeta"]
    rows = {(r.corredor, r.hora, r.intensidad_veh_h) for r in got.collect()}
    assert rows == {(str(i), str(i + 100), None) if i % 3 == 0 else (str(i + 100), str(i), None) if i % 3 == 1 else (str(i), None, str(i + 100)) for i in range(60)}
