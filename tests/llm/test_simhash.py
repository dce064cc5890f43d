from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from calzada.llm import simhash
from calzada.llm.components import components


def brute(rows):
    prints = {}
    for i, (_, text) in enumerate(rows):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ")
                 .replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        shingles = [" ".join(words[k:k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def made():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, "solo text of its own kind here"), (7, None), (8, ""), (9, " \t\n"), (10, "One"), (10, "One"), (11, "one"), (12, "É a B c d"), (13, "é A b C d")]
    for d in range(100, 160):
        base = rng.choices(words, k=rng.randint(60, 300))
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((d * 1_000 + rng.randint(0, 999), " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_components_are_those_of_all_pairs(spark, block):
    rows = made()
    df = spark.createDataFrame([(i, t, "c", "k") for i, t in rows], "doc_id bigint, text string, component_id string, fp string")
    assert sorted(map(tuple, simhash.near_duplicates(df, block=block).collect()), key=str) == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("chosen", [[(list(range(0, 32)), 2), (list(range(32, 64)), 1)], [(list(range(16 * i, 16 * i + 16)), int(i == 0)) for i in range(4)]])
def test_every_link_is_found_whatever_the_plan(spark, chosen):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, 150, dtype=np.uint64)
    near = base.copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    fps = np.unique(np.concatenate((base, near)))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    found = {(r.node, r.root) for r in components(simhash.bucket_links(simhash.keys(df, chosen), 4)).collect()}
    links = spark.createDataFrame([(int(fps[i].view(np.int64)), int(fps[j].view(np.int64))) for i in range(len(fps)) for j in range(i)
                                   if int(fps[i] ^ fps[j]).bit_count() <= 4], "a bigint, b bigint")
    assert found == {(r.node, r.root) for r in components(links).collect()}


def test_thresholds_add_up():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 2 ** 63, 2_000, dtype=np.uint64)
    for n in (10, 10 ** 5, 10 ** 9):
        chosen = simhash.plan(sample, n, 4)
        assert len({b for bits, _ in chosen for b in bits}) == sum(len(bits) for bits, _ in chosen)
        assert sum(t + 1 for _, t in chosen) == 5
    assert simhash.plan(np.zeros(0, np.uint64), 0, 4)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(1_000, 2_000 + i) for i in range(50)] + [(5_000, 5_000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 1_000: 1_000, **{2_000 + i: 1_000 for i in range(50)}}


def test_one_row_of_a_component_stays_whatever_shares_its_id(spark):
    say = lambda k: " ".join(f"v{k}x{i}" for i in range(80))
    rows = [(1, say(0)), (1, say(1)), (1, say(0)), (2, say(0)), (3, say(1)), (None, say(2)), (None, say(2)), (None, say(3)), (None, say(1)), (4, None), (None, "")]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, say(0)), (1, say(1)), (None, say(2)), (None, say(3)), (4, None)], key=str)
