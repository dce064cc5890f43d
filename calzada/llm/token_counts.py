"""Token counts by rank-synchronous merging over ragged arrays.

All distinct pre-tokens of a slice lie end to end in one array of symbols. In each round every sequence merges
its own lowest-ranked pair, wherever it occurs, all sequences at once; sequences without a mergeable pair drop
out. What is left of a sequence is its number of tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calzada.llm.bpe import KEPT_TOKENS, slices
from calzada.llm.unicode_level import find_all, lower

ROUND_SYMBOLS = 2_000_000


class Merges:
    """The pair ranks of a vocabulary file with word ends, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # Of a pair that is listed twice the later rank counts.
        last = {int(k): i for i, k in enumerate(keys)}
        order = np.array(sorted(last.values(), key=keys.__getitem__), np.int64)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.final = np.array([vocab[c + end] for c in alphabet], np.int32)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.none = np.int32(len(pairs))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each (non-empty) pre-token."""
        out = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROUND_SYMBOLS, "right")))
            out[at:to] = self._counts(b"".join(words[at:to]), lengths[at:to])
            at = to
        return out

    def _counts(self, data: bytes, lengths: np.ndarray) -> np.ndarray:
        out = lengths.copy()
        symbols = self.inner[np.frombuffer(data, np.uint8)]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[np.frombuffer(data, np.uint8)[last]]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            pair = np.full(len(symbols), self.none, np.int32)
            same = np.flatnonzero(owner[1:] == owner[:-1])
            pair[same] = self.rank(symbols[same], symbols[same + 1])
            sizes = np.diff(np.concatenate((starts, [len(symbols)])))
            lowest = np.minimum.reduceat(pair, starts)
            out[owner[starts]] = sizes
            # Finished sequences leave; the others merge every occurrence of their lowest pair.
            active = np.repeat(lowest < self.none, sizes)
            hit = (pair == np.repeat(lowest, sizes)) & active
            where = np.flatnonzero(hit)
            # Occurrences that overlap (a pair of equal symbols in a run) are taken from the left, every other one.
            first = np.concatenate(([True], np.diff(where) != 1)) if len(where) else np.zeros(0, bool)
            run = np.flatnonzero(first)
            step = np.arange(len(where)) - np.repeat(run, np.diff(np.concatenate((run, [len(where)]))))
            where = where[(step % 2 == 0)]
            symbols[where] = self.made[pair[where]]
            active[where + 1] = False
            symbols, owner = symbols[active], owner[active]
        return out


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte: itself if printable Latin-1, else the next code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Counter:
    def __init__(self, merges: Merges):
        self.merges = merges
        self.pattern = regex.compile(merges.pattern)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(merges.special, key=len, reverse=True)))
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings: composed, lower case letter by letter, blanks dropped."""
        return find_all(self.pattern, lower(unicodedata.normalize("NFC", text)))

    def count(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > KEPT_TOKENS:
            self.known = {}
        words: list[str] = []
        sizes, extra = [], []
        for text in texts:
            before = len(words)
            parts = self.special.split(text) if text else []
            for part in parts:
                words += self.pieces(part)
            sizes.append(len(words) - before)
            extra.append(max(0, len(parts) - 1))
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.known.update(zip(new, self.merges.counts([w.encode() for w in new]).tolist()))
        each = np.concatenate(([0], np.cumsum(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))))
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        return np.diff(each[ends]) + np.array(extra, np.int64)


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    NULL and empty texts have 0 bytes and 0 tokens. A special string inside a text is one token. Repeated rows
    are counted each. Other columns are ignored. The merges are broadcast; they are as large as their file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Merges(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            done = [counter.count(part.to_pylist()) for part in slices(batch.column(1))]
            tokens = pa.array(np.concatenate(done) if done else [], pa.int64())
            size = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, tokens], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
