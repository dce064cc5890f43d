from __future__ import annotations

import pytest

import numpy as np

from calzada.llm import topk


def brute(rows, k=20, every=20):
    whole = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in whole:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, query string, score int")


def test_products_with_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1_000 + i, rows[40][1]) for i in range(150)] + [(2_000 + i, np.round(rng.normal(size=8)).tolist()) for i in range(200)]
    rows += [(3_000, None), (3_020, [1.0, None] * 4), (3_040, [float("nan")] * 8), (3_060, [float("inf")] * 8), (None, [0.0] * 8),
             (3_080, [1.0, 2.0]), (3_081, [2.0, 1.0]), (3_100, [0.0] * 8), (-20, [-5.0] * 8), (3_120, [])]
    got = topk.top_products(frame(spark, rows), chunk=300, block=10)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert topk.top_products(frame(spark, rows).limit(0)).count() == 0


def test_bounds_spare_distances_and_stay_exact():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 200
    vectors = np.floor(centres[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 16)) * 5).astype(np.int64)
    tree = topk.MTree(np.arange(20_000), vectors, leaf=64, fan=8)
    for i in range(0, 20_000, 997):
        scores = vectors @ vectors[i]
        want = [j for j in np.lexsort((np.arange(20_000), -scores)) if j != i][:20]
        assert [id for _, id in tree.search(vectors[i], i, 20)] == want
    assert tree.computed < 0.5 * 21 * 20_000


def test_products_beyond_floating_point():
    vectors = np.array([[2 ** 30, 1], [2 ** 30, 2], [2 ** 30, 3], [1, 1]], np.int64)
    tree = topk.MTree(np.arange(4), vectors)
    assert tree.search(vectors[2], 2, 2) == [(2 ** 60 + 6, 1), (2 ** 60 + 3, 0)]


def test_copies_of_the_query_take_no_place(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1, 300)]
    rows += [(40, [9.0] * 8)] * 30
    got = sorted(map(tuple, topk.top_products(frame(spark, rows)).where("query_id = 40").collect()))
    # The 31 rows are two queries by vector, the one from the range and the repeated one.
    want = [r for i in sorted({tuple(v) for j, v in rows if j == 40}) for r in brute([(40, list(i)), *(x for x in rows if x[0] != 40)]) if r[0] == 40]
    assert got == sorted(want)


def test_own_rows_in_a_leaf():
    vectors = np.arange(1, 301)[:, None] * np.ones((1, 4), np.int64)
    ids = np.where(np.arange(300) < 200, np.arange(300), 500)
    tree = topk.MTree(ids, vectors)
    assert [id for _, id in tree.search(vectors[299], 500, 20)] == list(range(199, 179, -1))


def test_products_beyond_64_bits_end_with_an_error(spark):
    rows = [(0, [1e20, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0])]
    for big in (1e20, 1e17, -1e300):
        with pytest.raises(OverflowError):
            topk.top_products(spark.createDataFrame([(0, [big, 1.0]), *rows[1:]], "vec_id bigint, embedding array<double>"))
    fine = topk.top_products(spark.createDataFrame([(0, [1e6, 1.0]), *rows[1:]], "vec_id bigint, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in fine] == [(2, 64_000_000 * 128 + 4096), (1, 64_000_000 * 64 + 4096)]
