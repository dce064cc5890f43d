from __future__ import annotations

import math
import random
import re
from collections import Counter

from calzada.llm import lexical


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in counted:
            m = 100 - 90 + 90 * c.total() * n_docs // total
            score = 0
            for term in set(terms(text)):
                if tf := c[term]:
                    df = sum(term in other for _, other in counted)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1_000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    docs = spark.createDataFrame([(*r, 3, 4) for r in docs], "doc_id bigint, text string, score int, item bigint").repartition(5)
    items = spark.createDataFrame([(*r, 3, 4) for r in items], "item_id bigint, text string, rank int, doc_id int")
    return sorted(map(tuple, lexical.ranked(docs, items, **more).collect()), key=str)


WORDS = [*"abcdefgh", "ab", "abc", "Ñandú", "É", "é", "日本", "𝔘x", "x1", "42", "ß", "İ", "the", "THE", "\x80y"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "\n", "_", "\0", "--", "\x7f"]) for _ in range(rng.choice([1, 5, 40])))) for i in range(n)]


ODD = [(900, None), (901, ""), (902, " ,.;\n"), (None, "a b the"), (None, "a b the"), (903, "abc"), (903, "abc"), (903, "b"), (-5, "abc"), (904, "the " * 40_000), (905, "a" * 50_000)]


def test_ranks_of_odd_rows(spark):
    docs = corpus(300) + ODD
    items = [(0, "a the abc"), (1, None), (2, ""), (3, "zzz"), (None, "42 É"), (None, "x1"), (4, "THE the İ"), (4, "ñandú Ñandú 日本"), (5, "a the abc"), (5, "a the abc"),
             (6, "".join(WORDS)), (7, " ".join(WORDS)), (8, "a" * 50_000 + " 𝔘X"), (9, "\x80y é")]
    want = brute(docs, items)
    assert found(spark, docs, items) == want and len(want) > 60
    # Several walks, an item with a walk of its own, and few scores at a time.
    assert found(spark, docs, items, term_bytes=40, items_to_a_walk=4) == want
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_ties_and_copies(spark):
    docs = [(i, "one two" if i % 3 else f"two w{i}") for i in range(400, 0, -1)]
    assert found(spark, docs, [(1, "one"), (2, "two"), (3, "w9")]) == brute(docs, [(1, "one"), (2, "two"), (3, "w9")])


def test_empty_tables(spark):
    for docs, items in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])):
        assert found(spark, docs, items) == []


def test_cutting_while_walking(spark, monkeypatch):
    for name in ("CELLS", "COUNTS", "WAITING"):
        monkeypatch.setattr(lexical, name, 8)
    best = lexical.Best(2, 3)
    import numpy as np

    rng = random.Random(2)
    rows = [(rng.randint(0, 9), rng.randint(0, 9), i) for i in range(200)]
    for a, b, i in rows:
        best.add(np.array([[a, b]]), np.array([i]), np.array([1]))
    best.cut()
    for item in (0, 1):
        want = sorted((-r[item], r[2]) for r in rows if r[item] > 0)[:3]
        own = best.item == item
        assert [(-s, i) for s, i in zip(best.score[own].tolist(), best.id[own].tolist())] == want


def test_every_character_folds_as_the_pattern_says():
    scanner = lexical.Scanner([])
    for start in range(0, 0x110000, 0x1000):
        for c in range(start, start + (0x1000 if start < 0x3000 else 0x40)):
            if not 0xD800 <= c < 0xE000:
                assert scanner.count(f"a{chr(c)}a".encode())[0] == len(terms(f"a{chr(c)}a")), hex(c)
