from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from calzada.operators import clustering as C
from calzada.sources.writers import write_clustered_by_year, write_parquet_by_year


def test_cuts_are_quantiles_of_skewed_and_null_values(spark):
    rng = random.Random(3)
    values = ["hot"] * 500 + [f"c{rng.randrange(90):02d}" for _ in range(480)] + [None] * 20
    rng.shuffle(values)
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, i int")
    known = sorted(v for v in values if v is not None)
    for bits in (1, 3, 6):
        first = [next((v for v in dict.fromkeys(known) if known.index(v) * 2**bits // len(known) >= i), None) for i in range(1, 2**bits)]
        cuts = C.range_cuts(df, "v", bits)
        assert cuts == first
        got = {r.v: r.n for r in df.select("v", C.range_number(F.col("v"), cuts, "string").alias("n")).distinct().collect()}
        assert got == {v: 0 if v is None else known.index(v) * 2**bits // len(known) for v in set(values)}


def test_bits_are_interleaved(spark):
    rng = random.Random(4)
    rows = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c int").select("*", C.interleaved([F.col("a"), F.col("b"), F.col("c")]).alias("z"))
    for r in df.collect():
        assert r.z == int("".join(f"{x:08b}{y:08b}{z:08b}"[i + 8 * k] for x, y, z in [(r.a, r.b, r.c)] for i in range(8) for k in range(3)), 2)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "a string, anio int, _x double")
    assert C.clustered(empty, ["a", "_x"]).count() == 0 and C.clustered(empty, ["a", "_x"]).columns == empty.columns
    odd = spark.createDataFrame([(None, None), (None, None), ("é", float("nan")), ("", -1.0), ("", -1.0)], "a string, b double")
    assert sorted(map(str, C.clustered(odd, ["a", "b"]).collect())) == sorted(map(str, odd.collect()))


def test_three_filters_leave_out_blocks(spark, tmp_path):
    day = datetime.date(2020, 1, 1)
    df = spark.range(400_000).select(
        F.format_string("c%02d", F.floor(F.rand(1) * F.rand(2) * 50).cast("int")).alias("corredor"), F.date_add(F.lit(day), F.floor(F.rand(3) * 365).cast("int")).alias("fecha"),
        F.floor(F.rand(4) * 24).cast("int").alias("hora"), F.lit(2020).alias("anio"), F.col("id")).cache()
    write_parquet_by_year(df, f"{tmp_path}/sorted")
    write_clustered_by_year(df, f"{tmp_path}/curve", ["corredor", "fecha", "hora"])
    back = spark.read.parquet(f"{tmp_path}/curve")
    assert back.agg(F.count("*"), F.bit_xor(F.xxhash64("corredor", "fecha", "hora", "anio", "id"))).first() == \
        df.agg(F.count("*"), F.bit_xor(F.xxhash64("corredor", "fecha", "hora", "anio", "id"))).first()
    month = (datetime.date(2020, 3, 1), datetime.date(2020, 3, 31))
    ranges = {"corredor": {"corredor": ("c40", "c40")}, "fecha": {"fecha": month}, "hora": {"hora": (7, 8)}, "fecha_hora": {"fecha": month, "hora": (7, 8)},
              "todos": {"corredor": ("c05", "c09"), "fecha": month, "hora": (7, 8)}}
    share = {}
    for layout in ("sorted", "curve"):
        found = C.blocks_read(spark.read.parquet(f"{tmp_path}/{layout}"), ranges, rows=1_000).collect()
        assert len(found) == 5 and all(r.match <= r.may_match <= r.blocks for r in found)
        share[layout] = {r["filter"]: r.may_match / r.blocks for r in found}
    print(share)
    assert all(share["sorted"][n] > 0.9 for n in ("fecha", "hora", "fecha_hora"))
    assert share["curve"]["fecha"] < 0.4 and share["curve"]["hora"] < 0.4 and share["curve"]["fecha_hora"] < 0.15 and share["curve"]["todos"] < 0.1
