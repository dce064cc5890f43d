"""Exact samples of each file."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from calzada.operators import sampling


def table(spark, parts):
    """Files of many sizes, one of which is two thirds one and the same row."""
    rows = [(f"f{i}", f"{i}-{j}", None if j % 3 else "x") for i, n in enumerate((1, 3, 7, 10, 30, 997)) for j in range(n)]
    rows += [("grande", "igual", None)] * 4_000 + [("grande", str(j), "y") for j in range(2_000)] + [(None, str(j), "z") for j in range(41)]
    return spark.createDataFrame(rows, "archivo string, a string, b string").repartition(parts), Counter(r[0] for r in rows)


def drawn(df, fraction=0.15, seed=42):
    return Counter(map(tuple, sampling.exact_sample(df, fraction, seed).collect()))


@pytest.mark.parametrize("ordered, bits", [(5_000, 10), (20, 10), (0, 20)])
def test_every_file_gives_its_share(spark, monkeypatch, ordered, bits):
    monkeypatch.setattr(sampling, "ORDERED", ordered)
    monkeypatch.setattr(sampling, "STEP", bits)
    monkeypatch.setattr(sampling, "COPIES", 7)
    df, sizes = table(spark, 3)
    got = drawn(df)
    taken = Counter()
    for (file, *_), n in got.items():
        taken[file] += n
    assert {f: taken[f] for f in sizes} == {f: round(0.15 * n) for f, n in sizes.items()}
    whole = Counter(map(tuple, df.collect()))
    assert all(n <= whole[r] for r, n in got.items())


def test_the_same_rows_whatever_the_partitions(spark):
    one, _ = table(spark, 1)
    many, _ = table(spark, 9)
    assert drawn(one) == drawn(many.orderBy(F.rand(1)))
    assert drawn(one) != drawn(one, seed=43)


def test_all_and_none(spark):
    df, sizes = table(spark, 2)
    assert drawn(df, 1.0) == Counter(map(tuple, df.collect()))
    assert drawn(df, 0.0) == Counter() and drawn(df.limit(0)) == Counter()
