"""Reload without a gap."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from calzada.sources.versions import VersionedTable


def rows(spark, value, n=1_000):
    return spark.range(n).select("id", F.lit(value).alias("v"))


def seen(df):
    return {(r.v, r.n) for r in df.groupBy("v").agg(F.count("*").alias("n")).collect()}


def test_readers_see_one_load_whole(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.reload(rows(spark, 0))
    opened = table.read()
    found, stop = [], threading.Event()

    def look():
        while not stop.is_set():
            found.append(frozenset(seen(VersionedTable(spark, str(tmp_path / "t")).read())))

    reader = threading.Thread(target=look)
    reader.start()
    try:
        for value in (1, 2, 3):
            looks = len(found)
            table.reload(rows(spark, value), partition_by=["v"])
            while reader.is_alive() and len(found) < looks + 2:
                time.sleep(0.05)
    finally:
        stop.set()
        reader.join()
    assert set(found) <= {frozenset({(v, 1_000)}) for v in range(4)} and len(found) > 5
    assert seen(opened) == {(0, 1_000)} and seen(table.read()) == {(3, 1_000)}


def test_a_failed_load_changes_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.reload(rows(spark, 1))
    bad = rows(spark, 2).withColumn("id", F.when(F.col("id") == 900, F.raise_error(F.lit("roto"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="roto"):
        table.reload(bad)
    assert seen(table.read()) == {(1, 1_000)}
    # A load that ends between its rows and its pointer has changed nothing either.
    table.write(rows(spark, 3))
    assert seen(table.read()) == {(1, 1_000)} and len(table.versions()) == 1


def test_a_table_may_be_made_from_itself(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.reload(rows(spark, 1))
    table.reload(table.read().withColumn("v", F.col("v") + 1))
    assert seen(table.read()) == {(2, 1_000)}


def test_old_loads_expire(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    for value in range(3):
        table.reload(rows(spark, value))
    table.write(rows(spark, 9))
    assert table.expire(3_600) == 0 and len(table.versions()) == 3
    assert table.expire(-5) == 3
    assert [v.number for v in table.versions()] == [3] and seen(table.read()) == {(2, 1_000)}
    assert table.expire(-5) == 0
    table.reload(rows(spark, 4))
    assert seen(table.read()) == {(4, 1_000)}


def test_loads_that_end_together_have_an_order(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    names = [one.write(rows(spark, 1)), two.write(rows(spark, 2))]
    before = one.versions
    one.versions = two.versions = lambda: []
    one.publish(names[0])
    two.publish(names[1])
    one.versions = before
    assert {v.number for v in one.versions()} == {1}
    assert seen(one.read()) == seen(VersionedTable(spark, str(tmp_path / "t")).read())
