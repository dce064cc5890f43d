from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calzada.llm import negatives


def brute(rows, every=100, scale=256):
    whole = [(i, [math.floor(scale * float(x)) for x in v], l) for i, v, l in rows
             if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, q, l in {(i, tuple(v), l) for i, v, l in whole if i % every == 0}:
        met = [(-dot(q, v), j, m) for j, v, m in whole if len(v) == len(q)]
        for s, p, _ in sorted(x for x in met if x[2] == l and x[1] != i)[:5]:
            far = sorted(x for x in met if x[2] != l and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(far)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, norm double, anchor string")


def found(spark, rows, **more):
    return sorted(map(tuple, negatives.hard_negatives(frame(spark, rows), F.col("label"), **more).collect()))


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for size, dim in ((3, 1), (200, 700), (2 ** 20, 300), (2 ** 27, 64), (2 ** 30, 1)):
        a, b = rng.integers(-size, size + 1, (30, dim)), rng.integers(-size, size + 1, (40, dim))
        want = a.astype(object) @ b.astype(object).T
        assert (negatives.products(a, b).astype(object) == want).all()
    assert (negatives.products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)) == 0).all()
    edge = np.full((2, 1), 1_840_000_000) * [[1], [-1]]
    assert (negatives.products(edge, edge) == edge @ edge.T).all()


def test_residue_sums_stay_exact_in_single_precision():
    assert all((p // 2) ** 2 * negatives.DEPTH < 2 ** 24 for p in negatives.PRIMES)
    assert len(set(negatives.PRIMES)) == 7 and math.prod(negatives.PRIMES) < 2 ** 63
    assert len(negatives.primes_for(1)) == 1 and len(negatives.primes_for(2 ** 16)) == 2


def test_negatives_with_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (0.3 + 0.4 * rng.normal(size=6)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    rows += [(1_000 + i, rows[200][1], i % 3) for i in range(90)] + [(2_000 + i, np.round(2 * rng.normal(size=6)).tolist(), i % 4) for i in range(200)]
    rows += [(3_000, None, 1), (3_100, [1.0, None] * 3, 1), (3_200, [float("nan")] * 6, 2), (3_300, [float("inf")] * 6, 2), (None, [0.1] * 6, 1),
             (3_400, [1.0] * 6, None), (3_500, [1.0, 2.0], 0), (3_501, [1.0, 2.0], 0), (3_502, [1.0, 1.0], 1), (3_600, [0.0] * 6, 3), (-100, [-5.0] * 6, 3),
             (3_700, [], 0), (3_701, [], 0), (3_702, [], 1), *[rows[300]] * 7, (400, [9.0] * 6, 1), (400, [8.0] * 6, 2), *[rows[5]] * 3]
    random.Random(3).shuffle(rows)
    want = brute(rows)
    assert found(spark, rows, block=600) == want == found(spark, rows) and len(want) > 300
    assert found(spark, [(1, [1.0], 1)]) == [] and negatives.hard_negatives(frame(spark, rows).limit(0), F.col("label")).count() == 0


def test_a_third_of_the_rows_are_one_vector(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [0.5] * 4 if i % 3 else rng.random(4).astype(np.float32).tolist(), i % 2) for i in range(1_500)]
    assert found(spark, rows, block=400) == brute(rows)


def test_products_too_large_for_whole_numbers(spark):
    with pytest.raises(OverflowError):
        found(spark, [(100, [1e20, 1.0], 1), (101, [1.0, 2.0], 1)])
