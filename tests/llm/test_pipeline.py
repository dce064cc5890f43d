"""The pipeline's stages against plain versions of their own, none of which calls the operators."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re

import public_tokenizers
import tiktoken
import xxhash
import zstandard

import corpus_pipeline
from calzada.llm import language

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made():
    """Texts of two languages with copies that differ in blanks, near copies, junk, and sources of unlike size."""
    rng = random.Random(11)
    tongues = {"en": "the of and to in a is that for it was on are as with his they at be this from have".split(),
               "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split()}
    tongues = {lang: common + ["".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randint(4, 9))) + end for _ in range(150) for end in ends]
               for (lang, common), ends in zip(tongues.items(), (("ing", "ly"), ("ung", "lich")))}
    rows = []
    for i in range(90):
        lang = rng.choice(("en", "de"))
        rows.append([i, " ".join(rng.choices(tongues[lang], k=rng.randint(60, 400))), lang, ("web", "books", None, "tiny")[min(3, rng.randrange(8) // 2 if i % 9 else 3)]])
    for i in range(90, 110):  # equal but for blanks
        rows.append([i, rows[i - 90][1].replace(" ", "  ", i - 89).replace(" a ", "\n a\t"), rows[i - 90][2], "web"])
    for i in range(110, 140):  # one word more
        rows.append([i, rows[i - 70][1] + " " + "".join(rng.choices("xyz", k=5)), rows[i - 70][2], "books"])
    rows += [[140, None, "en", "web"], [141, "", "de", "web"], [142, "12 34 $$", "en", "web"], [143, " \n\t ", "en", "tiny"]]
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


def plain_rejected(text, learned):
    if not text or not any(c.isalpha() for c in text):
        return True
    data, sizes = text.lower().encode(), []
    for raw in learned.values():
        own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(press.compress(data[i:i + language.PIECE])) for i in range(0, len(data), language.PIECE)))
    best, second = sorted(sizes)[:2]
    return 1 - best / second < language.NARROW


def plain_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    """Smallest member of each member's component."""
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(low[a], low[b])
            changed = changed or low[a] != low[b]
            low[a] = low[b] = least
    return low


def plain_targets(sizes):
    """Shares by weight, no more than three times a source's size."""
    total, weight = sum(sizes.values()), {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full = set()
    while True:
        left, over = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in sizes if s not in full)
        share = {s: 3 * sizes[s] if s in full else left * weight[s] / over for s in sizes}
        more = {s for s in sizes if share[s] > 3 * sizes[s]} - full
        if not more:
            return share
        full |= more


def test_stages_against_plain_versions(spark, tmp_path):
    rows = made()
    now = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    held = {r.doc_id for r in now.where(language.held_out(3, 1)).collect()}
    learned = language.learn(now.where(~language.held_out(3, 1)))
    assert held and len(learned) == 2
    kept = {r[0]: r for r in rows}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "").write.parquet(f"{tmp_path}/{n}")
        now = spark.read.parquet(f"{tmp_path}/{n}")
        got = sorted((r.asDict() for r in now.collect()), key=lambda r: r["doc_id"])
        if name == "language_id":
            kept = {i: r for i, r in kept.items() if not plain_rejected(r[1], learned)}
            assert not {140, 141, 142, 143} & set(kept) and len(kept) > 130
        elif name == "exact_dedup":
            equal = collections.defaultdict(list)
            for i, r in kept.items():
                equal[BLANK.sub("", r[1])].append((-len(r[1]), i))
            assert len(equal) < len(kept) - 10
            kept = {i: kept[i] for i in (min(group)[1] for group in equal.values())}
        elif name == "simhash_dedup":
            prints = {i: plain_print(r[1]) for i, r in kept.items()}
            near = [(a, b) for a in kept for b in kept if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
            assert len(near) >= 10
            kept = {i: r for i, r in kept.items() if groups(kept, near)[i] == i}
        elif name == "mixing":
            words = {i: len(WORD.findall(r[1])) for i, r in kept.items()}
            sizes = collections.Counter()
            for i, r in kept.items():
                sizes[r[3]] += words[i]
            taken, times = collections.Counter(), collections.Counter(r["doc_id"] for r in got)
            for r in got:
                taken[r["source"]] += words[r["doc_id"]]
                assert tuple(r.values()) == kept[r["doc_id"]]
            assert max(times.values()) <= 3
            # The run of words that is taken cuts a document at either end.
            most = {s: max(words[i] for i, r in kept.items() if r[3] == s) for s in sizes}
            assert all(abs(taken[s] - target) <= most[s] + 1 for s, target in plain_targets(sizes).items())
        else:
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
            library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert [r["doc_id"] for r in got] == sorted(times.elements())
            for r in got:
                text = kept[r["doc_id"]][1]
                ids = library.encode_ordinary(text)
                assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
                assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        if name not in ("mixing", "byte_bpe"):
            assert [tuple(r.values()) for r in got] == sorted(kept.values()), name
