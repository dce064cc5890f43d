"""Exact quantiles from sketches, from counts, and kept up to date."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from calzada.operators import brackets, congestion, profile, quantiles, running

QS = (0.0, 0.25, 0.95, 1.0)


def plain(values, q):
    v = sorted(x for x in values if x is not None and math.isfinite(x))
    at = (len(v) - 1) * q
    low = math.floor(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)


def columns(n, seed=1):
    rng = random.Random(seed)
    return [(i % 3, rng.random() * 1e6, float(rng.randint(0, 3)), 7.0, rng.choice([None, float("nan"), float("inf"), -float("inf"), -1.0, 2.5]),
             float(i % 2) if i % 50 else rng.gauss(0, 1e-9), rng.gauss(0, 1) if i else 1e308) for i in range(n)]


NAMES = ["g", "casi_unica", "pocas", "una", "rara", "dos", "normal"]


@pytest.mark.parametrize("inside, points", [(0, 40), (5, 500), (20_000, 4)])
def test_brackets_find_every_rank(spark, monkeypatch, inside, points):
    monkeypatch.setattr(brackets, "EVEN", [i / points for i in range(points + 1)])
    rows = columns(2_000)
    df = spark.createDataFrame(rows, NAMES).repartition(5)
    found = {}
    first = df.agg(*[F.struct(F.count(brackets.finite(c)).alias("n"), brackets.sketch(brackets.finite(c), brackets.fractions(QS)).alias("points")).alias(c) for c in NAMES[1:]]).first()
    if inside:
        found = brackets.bracketed_quantiles(df, NAMES[1:], QS, {(None, c): (first[c].n, first[c].points) for c in NAMES[1:]}, inside=inside)
    else:  # a sketch that tells nothing
        found = brackets.bracketed_quantiles(df, NAMES[1:], QS, {(None, c): (first[c].n, []) for c in NAMES[1:]}, inside=3)
    for i, c in enumerate(NAMES[1:], 1):
        for q in QS:
            assert found[None, c, q] == pytest.approx(plain([r[i] for r in rows], q), rel=1e-12, abs=1e-300), (c, q)


def test_groups_by_sketch_and_by_order_agree(spark):
    rows = [*columns(3_000), (None, *columns(1)[0][1:]), (9, None, 1.0, 1.0, None, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, NAMES)
    for column in ("casi_unica", "pocas", "rara"):
        ways = [{(r.g, r.q): r.valor for r in quantiles.exact_quantiles(df, "g", column, QS, most).collect()} for most in (1_000, 2)]
        assert ways[0].keys() == ways[1].keys()
        for (g, q), x in ways[0].items():
            want = plain([r[NAMES.index(column)] for r in rows if r[0] == g], q)
            assert x == pytest.approx(want, rel=1e-12) and ways[1][g, q] == pytest.approx(want, rel=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), "g", "pocas", QS).count() == 0


def test_a_wrong_sketch_costs_a_scan_and_no_result(spark):
    rows = [(float(i),) for i in range(2_000)]
    df = spark.createDataFrame(rows, ["x"])
    wrong = [(f, 5_000.0 + i) for i, f in enumerate(brackets.EVEN)]
    found = brackets.bracketed_quantiles(df, ["x"], QS, {(None, "x"): (2_000, wrong)}, inside=100)
    assert all(found[None, "x", q] == pytest.approx(plain([r[0] for r in rows], q)) for q in QS)


def test_describe_in_two_scans(spark):
    rows = columns(5_000, 3)
    df = spark.createDataFrame(rows, NAMES).withColumn("texto", F.lit("x"))
    got = {r.columna: r for r in profile.describe(df).collect()}
    assert list(got) == NAMES
    for i, c in enumerate(NAMES):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[c]["count"] == len(values)
        if c in ("g", "casi_unica", "pocas", "dos"):
            assert got[c]["mean"] == pytest.approx(statistics.fmean(values), abs=1e-6) and (got[c]["min"], got[c]["max"]) == (min(values), max(values))
        assert [got[c][p] for p in ("p25", "p50", "p75")] == pytest.approx([plain(values, q) for q in (0.25, 0.5, 0.75)], abs=1e-6)
    assert profile.describe(df.limit(0)).where("count = 0 AND p50 IS NULL").count() == len(NAMES)
    assert profile.describe(df.select("texto")).count() == 0
    assert [tuple(r) for r in profile.column_types(df).collect()][-1] == (8, "texto", "string")


def test_running_index_is_that_of_a_full_run(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([2019, 2020, 2021]), rng.choice([None, float("nan"), -2.0, 5.0, 5000.0, rng.random() * 90])) for i in range(3_000)]
    rows += [(5_000 + i, 2030, None) for i in range(5)] + [(6_000, None, 3.0)]
    df = spark.createDataFrame(rows, "id int, anio int, ocupacion double")
    parts = [df.where("anio <= 2020 AND id % 2 = 0 OR anio = 2030"), df.where("anio <= 2020 AND id % 2 = 1"), df.where("anio >= 2021 AND anio < 2030 OR anio IS NULL")]
    stored = []
    state = running.RunningIndex(spark, str(tmp_path / "estado"))
    for i, part in enumerate(parts):
        part.write.parquet(str(tmp_path / f"lecturas/{i}"))
        stored.append(spark.read.parquet(str(tmp_path / f"lecturas/{i}")))
        touched = state.add(stored[-1], f"b{i}")
    assert touched == [2021] and state.add(stored[0], "b0") == [2019, 2020, 2030]
    for method in ("p95_year", "max_valid"):
        want = {r.id: r.indice_congestion for r in congestion.congestion_index(df.withColumn("ocupacion", brackets.finite("ocupacion")), method).collect()}
        clean = df.withColumn("ocupacion", brackets.finite("ocupacion"))
        assert {r.id: r.indice_congestion for r in state.attach(clean, method).collect()} == pytest.approx(want)
    # What the divisors are made from: counts, never a reading.
    assert all("/lecturas/" not in f for df in (state.counts(), state.p95(), state.index()) for f in df.inputFiles())
    with pytest.raises(ValueError):
        state.attach(df, "max")


def test_a_batch_scans_no_earlier_readings(spark, tmp_path, monkeypatch):
    first, second = (spark.createDataFrame([(year, float(i)) for i in range(50)], "anio int, ocupacion double") for year in (2019, 2020))
    state = running.RunningIndex(spark, str(tmp_path / "estado"))
    first.write.parquet(str(tmp_path / "uno"))
    state.add(spark.read.parquet(str(tmp_path / "uno")), "uno")
    for f in (tmp_path / "uno").glob("*.parquet"):
        f.write_bytes(b"")  # whoever reads it again fails
    for f in (tmp_path / "estado/conteos/lote=uno").rglob("*.parquet"):
        f.write_bytes(b"")  # nor are counts of years that the batch does not touch
    assert state.add(second, "dos") == [2020]
    assert {r.anio: r.p95 for r in state.p95().collect()} == pytest.approx({2019: 46.55, 2020: 46.55})
