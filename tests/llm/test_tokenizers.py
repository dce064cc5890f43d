from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from calzada.llm import bpe, token_counts

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
VOCABULARY = bpe.Vocabulary.from_file(RANKS)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
HF = Tokenizer.from_file(WORDS)
HAND = ["", " ", "a", "aaaaaaaaaaaa", "aaa" * 500, "don't  stop\n\n  now", "<|endoftext|>", "x<|startoftext|>Y <|endoftext|><|endoftext|>",
        "Σίσυφος ΟΔΟΣ ΟΔΟΣ.", "İstanbul ǅ ß ẞ", "éé", "ẛ̣", "\x1c\x1d a\x85b c​d", "日本語テキスト", "👩‍👩‍👧 ok",
        "½ ²x³ ٣٤", "_-_-__--", "'S 'ſ 'll'LL", "﻿BOM", "\x00\x01"]


def texts():
    rng = random.Random(5)
    marks = ["a", "the", "ing", " ", "  ", "\n", "'s", "'", "é", "É", "Σ", "ñ", "1", "23", "!!", "$$$", "中", " ", "<|endoftext|>", "🙂", "ZZ", "İ"]
    out = HAND + ["".join(rng.choices(marks, k=rng.randint(1, 60))) for _ in range(400)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0x24F), rng.randint(0x250, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(200)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out += ["a 1".join(points[i:i + 500]) for i in range(0, len(points), 500)]
    return out + ["".join(rng.choices("abcde", k=n)) for n in (100, 3_000, 20_000)]


def test_ids_are_those_of_the_library():
    ids, offsets = bpe.Encoder(VOCABULARY, P.PATTERN).encode(texts())
    for text, a, b in zip(texts(), offsets, offsets[1:]):
        assert ids[a:b].tolist() == TIKTOKEN.encode_ordinary(text), text[:80]


def test_decoding_gives_the_text_back():
    encoder = bpe.Encoder(VOCABULARY, P.PATTERN)
    ids, offsets = encoder.encode(texts())
    data, ends = VOCABULARY.decode(ids, offsets)
    for text, a, b in zip(texts(), ends, ends[1:]):
        assert data[a:b].tobytes() == text.encode()


def test_perfect_hash_is_minimal_and_perfect():
    tokens = list(VOCABULARY.ranks)
    numbers = VOCABULARY.hash.numbers(bpe.PerfectHash.digests(tokens))
    assert sorted(numbers.tolist()) == list(range(len(tokens)))


def test_merging_agrees_with_the_whole_lookup():
    assert all(VOCABULARY.merge(t) == [r] for t, r in list(VOCABULARY.ranks.items())[:20_000] if len(t) > 1 or r < 256)


def test_counts_are_those_of_the_library():
    got = token_counts.Counter(token_counts.Merges(WORDS)).count(texts())
    for text, n in zip(texts(), got.tolist()):
        assert n == len(HF.encode(text, add_special_tokens=False).ids), text[:80]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_TOKENS", 3)
    encoder = bpe.Encoder(VOCABULARY, P.PATTERN)
    for text in texts()[:60]:
        ids, _ = encoder.encode([text])
        assert ids.tolist() == TIKTOKEN.encode_ordinary(text)


ODD = [(1, "Hello hello", "x"), (2, None, None), (3, "", "y"), (None, "a b", "z"), (1, "Hello hello", "x"), (4, "word " * 5_000, "w")]
ODD_SCHEMA = "doc_id bigint, text string, ids string, n_tokens string, bytes string, `_x.y` int"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, c, c, c, 1) for i, t, c in ODD], ODD_SCHEMA)


def test_digests_of_odd_rows(odd):
    rows = bpe.digests(odd, RANKS, P.PATTERN).collect()
    want = []
    for i, t, _ in ODD:
        ids = TIKTOKEN.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe.digests(odd.limit(0), RANKS, P.PATTERN).count() == 0


def test_counts_of_odd_rows(odd):
    rows = token_counts.token_counts(odd, WORDS).collect()
    want = [(i, len((t or "").encode()), n := len(HF.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in ODD]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(odd.limit(0), WORDS).count() == 0


def test_null_ids_decode_to_null(spark):
    rows = spark.createDataFrame([([], 1), (None, 2), ([0, 1], 3)], "ids array<int>, n int")
    got = {r.n: r.bytes for r in bpe.decode(rows, RANKS).collect()}
    assert bytes(got[1]) == b"" and got[2] is None and bytes(got[3]) == VOCABULARY.decode(np.array([0, 1]), np.array([0, 2]))[0].tobytes()
