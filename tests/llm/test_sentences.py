from __future__ import annotations

import random

from calzada.llm import sentences as S


def brute(rows):
    """Over all pairs of runs, without hashes."""
    seen: dict[str, tuple] = {}
    runs = []
    for doc, text in rows:
        parts = S.sentences(text)
        words = [p.split() for p in parts]
        full = [i for i, w in enumerate(words) if w]
        for a in range(len(full)):
            for b in range(a, len(full)):
                inner = [w for i in full[a:b + 1] for w in words[i]]
                n, size = b - a + 1, len(inner)
                less_right, less_left = size - len(words[full[b]]), size - len(words[full[a]])
                several = n >= 2 and size >= 25 and (n == 2 or less_right < 25 or less_left < 25)
                if several or n == 1 and size >= 50:
                    runs.append((" ".join(inner), (doc is None, doc or 0, full[a]), doc, full[a], full[b] + 1))
    for key, place, *_ in runs:
        seen[key] = min(seen.get(key, place), place)
    gone: dict = {}
    for key, place, doc, start, stop in runs:
        if place != seen[key]:
            gone.setdefault(doc, set()).update(range(start, stop))
    out = []
    for doc, text in rows:
        parts = S.sentences(text)
        own = {i for i in gone.get(doc, ()) if i < len(parts)}
        out.append((doc, len(parts), len(own), text if not own else "".join(p for i, p in enumerate(parts) if i not in own)))
    return sorted(out, key=str)


def test_passages_and_odd_rows(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randint(0, 5_000)}" for _ in range(n))
    passage = ". ".join(say(9) for _ in range(6)) + "."
    rows = [(i, f"{say(30)}. {say(7)}.\n{say(12)}!") for i in range(30)]
    rows += [(100 + i, f"{say(8)}. {say(8)}. {passage} {say(8)}. {say(6)}.") for i in range(5)]
    rows += [(200, say(60)), (201, rows[-1][1]), (300, None), (301, ""), (302, " \n \n"), (303, "One. Two. One. Two."), (None, passage), (304, "x " * 3_000),
             (305, passage + "\n" + passage), (306, passage.replace(" ", "  ")), (0, "other text under a used id."), (7, rows[7][1]), (310, "no end")]
    df = spark.createDataFrame([(i, t, [1], 2) for i, t in rows], "doc_id bigint, text string, cuts array<int>, h int")
    got = sorted((tuple(r) for r in S.without_repeats(df).collect()), key=str)
    assert got == brute(rows)
    left = {r[0]: r for r in got}
    assert left[100][2] == 0 and all(left[100 + i][2] == 6 and "w" in left[100 + i][3] for i in range(1, 5))
    assert S.without_repeats(df.limit(0)).count() == 0


def test_cutting_loses_nothing():
    for text in ("a. b! c? d\ne\n\nf...g  . h", "...", "\n\n x", "x", "a.\tb"):
        assert "".join(S.sentences(text)) == text


def test_rows_that_share_an_id_are_told_apart(spark):
    say = lambda k: " ".join(f"v{k}x{i}" for i in range(15))
    passage = f"{say(0)}. {say(1)}. "
    rows = [(1, passage), (None, passage + "Left."), (None, f"{say(2)}. {say(3)}."), (None, f"{say(4)}. {say(5)}."), (None, f"{say(4)}. {say(5)}."),
            (7, f"{say(6)}. {passage}"), (7, f"{say(7)}. {say(8)}. {say(9)}.")]
    got = sorted(((r.doc_id, r.text) for r in S.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([rows[0], (None, "Left."), rows[2], rows[3], (None, ""), (7, f"{say(6)}. "), rows[6]], key=str)
