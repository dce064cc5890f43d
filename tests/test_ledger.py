"""Lines that do not fit, and runs that end anywhere."""

from __future__ import annotations

import csv
import gzip
import io
import random
import time

import pytest
from pyspark.sql import functions as F

from calzada.plans import etl
from calzada.sources import lines
from calzada.sources.schemas import RAW_COLUMNS
from calzada.streaming import ingest
from calzada.streaming.ledger import BEGUN, FAILED, LOADED, Ledger

HEADER = ",".join(RAW_COLUMNS)


def line(**cells):
    return ",".join(cells.get(c, "") for c in RAW_COLUMNS)


def put(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([HEADER, *rows]) + "\n", encoding="utf-8")


def test_shapes_are_those_of_a_standard_reader(spark):
    rng = random.Random(1)
    texts = sorted({"".join(rng.choice('ab,"" ,') for _ in range(rng.randint(1, 14))) for _ in range(3_000)})
    got = spark.createDataFrame([(t,) for t in texts], "linea string").select("linea", lines.line_shape(F.col("linea")).alias("s"),
                                                                             lines.fits(F.col("linea"), 3).alias("cabe")).collect()
    for r in got:
        cells = next(csv.reader(io.StringIO(r.linea + "\n")))
        open_quote = cells[-1].endswith("\n")
        assert (r.s.celdas, r.s.abierta) == (len(cells), open_quote), r.linea
        assert r.cabe == (len(cells) <= 3 and not open_quote)


@pytest.fixture(scope="module")
def monsters():
    """A million quoted cells, a million open quotes, a million plain cells."""
    return ["monstruo," + ",".join(['"x"'] * 10 ** 6), "monstruo," + '"' * (10 ** 6 + 1), "monstruo" + "," * 10 ** 6]


def test_no_line_ends_a_batch(spark, tmp_path, monsters):
    put(tmp_path / "in/2020/a.csv", line(corredor="buena", hora="2"), *monsters, line(corredor="otra", hora="3"))
    ingest.ingest_new_files(spark, str(tmp_path / "in"), str(tmp_path / "t"))
    assert sorted(r.registro for r in ingest.rejected(spark, str(tmp_path / "t")).collect()) == sorted(monsters)
    assert sorted(r.corredor for r in ingest.ingested(spark, str(tmp_path / "t")).collect()) == ["Buena", "Otra"]


def test_no_line_ends_the_batch_job(spark, tmp_path, monsters):
    put(tmp_path / "in/2020/a.csv", line(corredor="buena", hora="2") + ",sobra", *monsters)
    assert etl.parquet_job(spark, str(tmp_path / "in"), str(tmp_path / "t")).first().registros == 1
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t_rechazos")).collect()) == sorted(monsters)


def test_no_line_ends_a_stream(spark, tmp_path, monsters):
    odd = line(carril='"Calle ""A"", 5"', corredor="buena", hora="2")
    put(tmp_path / "in/2020/a.csv", odd, *monsters)
    ingest.csv_stream(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "log"))
    rows = [r for f in (tmp_path / "t").rglob("*.csv") for r in list(csv.reader(f.open(newline="")))[1:]]
    assert [len(r) for r in rows] == [24] and rows[0][0] == 'Calle "A", 5'
    wide = sorted(r.value for r in spark.read.text(str(tmp_path / "t_rechazos")).collect())
    assert wide == sorted(monsters)


def test_time_is_linear_in_the_line(spark):
    def seconds(n):
        df = spark.range(1).select(F.concat(F.lit("z"), F.repeat(F.lit(',"x"'), n)).alias("linea"))
        start = time.perf_counter()
        assert df.select(lines.line_shape(F.col("linea")).alias("s")).first().s.celdas == n + 1
        return time.perf_counter() - start

    seconds(50_000)
    small, large = min(seconds(100_000) for _ in range(2)), seconds(800_000)
    assert large < 30 * small + 2


class Ended(BaseException):
    """The process is gone; nothing may catch it."""


def base(tmp_path):
    put(tmp_path / "in/2019/a b%20ñ[1].csv", line(corredor="uno", hora="1"), line(corredor="dos", hora="2"))
    put(tmp_path / "in/2020/a.csv", line(corredor="tres", hora="3"))
    whole = gzip.compress(f"{HEADER}\n{line(corredor='nunca', hora='4')}\n".encode() * 2_000, mtime=0)
    (tmp_path / "in/2020/rota.csv.gz").write_bytes(whole[: len(whole) // 2])
    return str(tmp_path / "in"), str(tmp_path / "t"), whole


def names(spark, target):
    return sorted(r.corredor for r in ingest.ingested(spark, target).collect())


def test_a_run_may_end_after_any_step(spark, tmp_path, monkeypatch):
    append, write = Ledger.append, ingest._write_batch
    source, target, _ = base(tmp_path)
    (tmp_path / "in/2020/a.csv").unlink()
    left, steps = 0, []

    def done(step):
        steps.append(step)
        if len(steps) == left:
            raise Ended

    def append_and_end(self, files, state, error=None):
        append(self, files, state, error)
        done(state)

    def write_and_end(target):
        def run(rows, batch_id):
            write(target)(rows, batch_id)
            done("escrito")
        return run

    monkeypatch.setattr(Ledger, "append", append_and_end)
    monkeypatch.setattr(ingest, "_write_batch", write_and_end)
    left = -1
    ingest.ingest_new_files(spark, source, f"{target}0")
    every = list(steps)
    assert set(every) == {BEGUN, LOADED, FAILED, "escrito"}
    for left in range(1, len(every) + 1):
        steps.clear()
        with pytest.raises(Ended):
            ingest.ingest_new_files(spark, source, f"{target}{left}")
        if Ledger(spark, f"{target}{left}_libro").latest().where(F.col("estado") == LOADED).count():
            assert names(spark, f"{target}{left}") == ["Dos", "Uno"]
        steps.append("otra vez")
        steps.extend([""] * 100)
        ingest.ingest_new_files(spark, source, f"{target}{left}")
        assert names(spark, f"{target}{left}") == ["Dos", "Uno"], every[:left]
        assert [r.archivo.endswith("rota.csv.gz") for r in ingest.failed_files(spark, f"{target}{left}").collect()] == [True]


def test_changed_and_mended_files_replace_what_they_brought(spark, tmp_path):
    source, target, whole = base(tmp_path)
    ingest.ingest_new_files(spark, source, target)
    put(tmp_path / "in/2020/a.csv", line(corredor="cuatro", hora="3"), line(corredor="cinco", hora="3"))
    (tmp_path / "in/2020/rota.csv.gz").write_bytes(gzip.compress(f"{HEADER}\n{line(corredor='sana', hora='4')}\n".encode()))
    assert ingest.ingest_new_files(spark, source, target)
    assert names(spark, target) == ["Cinco", "Cuatro", "Dos", "Sana", "Uno"]
    assert ingest.failed_files(spark, target).count() == 0
    assert not ingest.ingest_new_files(spark, source, target)
    ledger = ingest.ledger_of(spark, target)
    assert {r.archivo[-8:]: r.intento for r in ledger.latest().collect()}["20/a.csv"] > 1
    assert ledger.events().where(F.col("estado") == BEGUN).count() > ledger.latest().count() == 3
    # Digests of whole paths: no two files share a place.
    assert ledger.loaded().select("lote").distinct().count() == 3 and all(len(r.lote) > 65 for r in ledger.loaded().collect())


def test_a_ledger_without_events(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "libro"))
    ledger.append([], BEGUN)
    assert ledger.latest().count() == 0 and ledger.loaded().count() == 0 and not ledger.exists()
