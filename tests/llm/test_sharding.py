from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from calzada.llm import sharding


def plain(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        ahead = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def key_of(id):
    return int(hashlib.md5(("null" if id is None else str(id)).encode()).hexdigest()[:16], 16)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id bigint, text string, shard int, law string")


def brute(rows, shards):
    placed: dict = {}
    for i, t in rows:
        placed.setdefault(plain(key_of(i), shards), []).append((f"{key_of(i):016x}", i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    return sorted(((i, size, crc, "key", shard, slot, plain(key_of(i), shards + 1)) for shard, own in placed.items()
                   for slot, (_, i, size, crc) in enumerate(sorted(own, key=lambda r: (r[0], r[2:])))), key=str)


ROWS = [(i, "t" * (i % 50)) for i in range(900)] + [(None, "é"), (None, None), (None, "é"), (5, ""), (-1, "\0"), (2 ** 63 - 1, "日本"), (-2 ** 63, "x" * 300_000)]


def test_jumps_are_those_of_the_plain_loop():
    keys = np.array([0, 1, 2 ** 64 - 1, *np.random.default_rng(1).integers(0, 2 ** 64, 500, dtype=np.uint64)], np.uint64)
    for shards in (1, 2, 16, 17, 1_000):
        assert sharding.jump(keys, shards).tolist() == [plain(int(k), shards) for k in keys]


def test_shards_and_slots(spark):
    rows = ROWS + [(77, "hot")] * 700
    random.Random(1).shuffle(rows)
    want = brute(rows, 16)
    for per_task in (100, 10 ** 6):
        got = sharding.shard_documents(frame(spark, rows).repartition(6), per_task=per_task)
        assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert sharding.shard_documents(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(frame(spark, rows), 0)


def test_one_shard_more_takes_rows_only_into_itself(spark):
    got = sharding.shard_documents(frame(spark, [(i, "") for i in range(5_000)])).toPandas()
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) == {16} and 0.6 < len(moved) / (5_000 / 17) < 1.4
    assert got.groupby("shard").size().between(200, 430).all()


def test_written_shards_hold_all_columns(spark, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(frame(spark, ROWS), path, shards=4, file_rows=100)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select("doc_id", "text", "law", "shard").collect())) == sorted(
        str(r) for r in frame(spark, [(i, t) for i, t in ROWS]).withColumn("shard", sharding.shard_of(F.col("doc_id"), 4)).select("doc_id", "text", "law", "shard").collect())
    assert {f for f in os.listdir(path) if f.startswith("shard=")} <= {f"shard={i}" for i in range(4)}
