"""Exact dedup and mixing on odd rows, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from calzada.llm import exact_dedup, mixing


def groups(rows):
    keyed = [(re.sub("[\x20\x09-\x0D]", "", t or ""), i, t or "") for i, t in rows]
    out = []
    for key in {k for k, _, _ in keyed}:
        own = [(i, t) for k, i, t in keyed if k == key]
        best = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(i, best, len(own), sha) for i, _ in own]
    return sorted(out, key=str)


ROWS = [(5, "a b"), (3, "ab"), (9, "a  b"), (1, None), (2, ""), (4, " \t"), (None, "q"), (None, " q"), (7, "É \x0b"), (8, "É"), (6, "é"),
        (10, "x" * 50_000), (11, "x " * 50_000), (12, "same"), (12, "same"), (-2, "sa me"), (13, "a b"), (14, "a\x1cb")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 0, True) for i, t in rows], "doc_id bigint, text string, digest string, keep_id int, kept boolean")


def test_groups_of_odd_rows(spark):
    got = exact_dedup.exact_groups(frame(spark, ROWS)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == groups(ROWS)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_groups(frame(spark, ROWS).limit(0)).count() == 0


def test_equal_digests_of_different_bytes_are_told_apart(spark):
    weak = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 1) if False else F.encode(F.substring(text, 1, 1), "utf-8")
    rows = ROWS + [(20 + i, f"same start {i % 3}") for i in range(9)]
    got = exact_dedup.exact_groups(frame(spark, rows), digest=weak).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == groups(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_state_goes_on_from_where_it_was(spark, tmp_path):
    keys, state = str(tmp_path / "keys"), str(tmp_path / "state")
    for rows in (ROWS[:6], ROWS[6:]):
        exact_dedup.row_keys(frame(spark, rows)).write.mode("append").parquet(keys)
        found = exact_dedup.update_state(spark, keys, state)
    assert sorted(r.group_size for r in found.collect()) == sorted(n for (_, _, n, _) in {g[1:2] + g[1:] for g in groups(ROWS)})


def test_dropping_copies_keeps_columns(spark):
    kept = exact_dedup.drop_exact_copies(frame(spark, ROWS))
    assert kept.columns == frame(spark, ROWS).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({g[1] if g[1] is not None else None for g in groups(ROWS)}, key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    names = ["big"] * 12 + ["b", "c", "d", None, "é", "Z"]
    return [(i, " ".join(["w"] * rng.choice([1, 5, 40, 200])), rng.choice(names)) for i in range(n)]


def mixed(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, size int, words int")
    return [r.asDict() for r in mixing.mix(df, **more).collect()]


def expected_targets(rows):
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return sizes, {s: share.get(s, 3 * sizes[s]) for s in order}
        capped |= over


def test_mix_meets_its_targets(spark):
    rows = corpus(6_000)
    sizes, targets = expected_targets(rows)
    for more in ({}, {"shard_docs": 50}):
        got = mixed(spark, rows, **more)
        assert sorted(got, key=str) == sorted(mixed(spark, rows, **more), key=str)
        assert len(got) == len(rows)
        taken: dict = {}
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
            assert abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, r["target"])
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert all(abs(taken[s] - t) <= max(200, 0.02 * t) for s, t in targets.items()), (taken, targets)


def test_small_sources_meet_their_targets(spark):
    rng = random.Random(4)
    for kinds in ([1], [3], [10], [50], [0, 1, 2, 7, 15, 16, 17, 400]):
        rows = [(i, " ".join("w" * rng.choice(kinds)), f"s{i % 150}") for i in range(300)]
        sizes, targets = expected_targets(rows)
        taken = dict.fromkeys(sizes, 0)
        for r in mixed(spark, rows):
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        assert sum(taken.values()) == sum(sizes.values())
        assert all(abs(taken[s] - t) <= 2 for s, t in targets.items())


def test_many_rows_without_identifier_fall_to_many_shards(spark):
    got = mixed(spark, [(None, f"word {i} " * (i % 5), "s") for i in range(400)], shard_docs=20)
    assert sum(r["taken"] for r in got) == sum(r["size"] for r in got)


def test_capped_items_hand_their_seats_on(spark):
    votes = [(0, i, v, 20, c) for i, (v, c) in enumerate([(10.0, 4), (10.0, 100), (0.0, 0), (1.0, 100)])]
    got = mixing.apportion(spark.createDataFrame(votes, "g int, i int, vote double, seats bigint, cap bigint"), "g", "i").collect()
    won = {r.i: r.blocks for r in got}
    assert won[0] == 4 and won[2] == 0 and set(won) == {0, 1, 2, 3}


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", None), (None, "x y", "b"), (5, "z", ""), (5, "z", ""), (6, "w " * 30_000, "c")]
    got = mixed(spark, rows)
    sizes, targets = expected_targets(rows)
    assert sorted((r["size"], r["source_size"]) for r in got) == sorted((len((t or "").split()), sizes[s]) for _, t, s in rows)
    assert mixed(spark, rows[:0] or [(1, None, None)])[0]["taken"] == 0
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_seats_are_those_of_the_highest_quotients(spark):
    rng = random.Random(9)
    for _ in range(3):
        votes = [(g, i, float(rng.choice([0, 1, 5, 50, 1_000, rng.random() * 100]))) for g in (1, 2) for i in range(rng.randint(1, 12))]
        seats = {1: rng.randint(0, 300), 2: 7}
        got = mixing.apportion(spark.createDataFrame([(g, i, v, seats[g]) for g, i, v in votes], "g int, i int, vote double, seats bigint"), "g", "i").collect()
        for g in (1, 2):
            own = {i: v for h, i, v in votes if h == g}
            if not sum(own.values()):
                continue
            won = {i: 0 for i in own}
            for _ in range(seats[g]):
                best = min(own, key=lambda i: (-own[i] / (2 * won[i] + 1), i))
                won[best] += 1
            assert {r.i: r.blocks for r in got if r.g == g} == won
