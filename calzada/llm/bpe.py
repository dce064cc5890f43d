"""Byte-level BPE with a two-tier lookup.

Pre-tokens that are in the vocabulary as a whole are found through a minimal perfect hash over it; the others
are merged with a heap of candidate pairs over linked bytes. Both tiers run once per distinct pre-token of a
slice of text; what has been resolved is kept for the task, up to a bound that affects speed only.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calzada.llm.unicode_level import find_all

SLICE_CHARS = 1_000_000
KEPT_TOKENS = 200_000


class PerfectHash:
    """Minimal perfect hash: levels of bit arrays; keys alone in their slot of a level stay there, the rest go on.

    A key's number is the count of set bits before its slot. Unknown keys get some number or -1, so the caller
    compares the key itself.
    """

    def __init__(self, keys: list[bytes]):
        left = self.digests(keys)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        start = 0
        while len(left):
            slots = self._slots(left, len(self.levels), 2 * len(left))
            counts = np.bincount(slots.astype(np.int64), minlength=2 * len(left))
            taken = counts == 1
            self.levels.append((taken, start + np.cumsum(taken) - taken))
            start += int(taken.sum())
            left = left[~taken[slots]]
            if len(self.levels) > 64:
                raise ValueError("two keys share a 64-bit digest")

    @staticmethod
    def digests(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    @staticmethod
    def _slots(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (digests ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(32)) % np.uint64(size)

    def numbers(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1, np.int64)
        open_ = np.arange(len(digests))
        for level, (taken, before) in enumerate(self.levels):
            slots = self._slots(digests[open_], level, len(taken))
            hit = taken[slots]
            out[open_[hit]] = before[slots[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


class Vocabulary:
    """Ranks of byte strings, ready for both tiers and for decoding. Its size is that of the vocabulary file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.place = [b""] * len(tokens)
        for token, at in zip(tokens, self.hash.numbers(PerfectHash.digests(tokens)).tolist()):
            self.place[at] = token
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.fromiter(map(len, by_id), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        """Reads a rank file: a base64 token and its rank on each line."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens: whole ones by the perfect hash, the others by merging."""
        numbers = self.hash.numbers(PerfectHash.digests(words)).tolist()
        ranks, place = self.ranks, self.place
        return [[ranks[w]] if n >= 0 and place[n] == w else self.merge(w) for w, n in zip(words, numbers)]

    def merge(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first among equals; a part is known by its start, linked to its neighbours."""
        ranks, n = self.ranks, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        after.append(n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, end = pop(heap)
            middle = after[i]
            # Stale when a part is gone (its link is -1) or the pair has grown since.
            if middle < 0 or middle >= n or after[middle] != end:
                continue
            after[i], after[middle], before[end] = end, -1, i
            if end < n and (r := ranks.get(word[i:after[end]])) is not None:
                push(heap, (r, i, after[end]))
            left = before[i]
            if left >= 0 and (r := ranks.get(word[left:end])) is not None:
                push(heap, (r, left, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i:after[i]]])
            i = after[i]
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of several id lists laid end to end, and the offsets of each list's bytes."""
        lengths = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(self.starts[ids] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.bytes[at], ends[offsets]


class Encoder:
    """Encodes texts slice by slice; distinct pre-tokens are numbered, their ids lie in one growing array."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each text's ids."""
        if len(self.codes) > KEPT_TOKENS:
            self._forget()
        words: list[str] = []
        counts = []
        for text in texts:
            found = find_all(self.pattern, text) if text else []
            words += found
            counts.append(len(found))
        codes = self.codes
        new = [w for w in dict.fromkeys(words) if w not in codes]
        if new:
            lists = self.vocabulary.encode_many([w.encode() for w in new])
            codes.update(zip(new, range(len(codes), len(codes) + len(new))))
            self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, lists), np.int64, len(lists))))
            self.ids = np.concatenate((self.ids, np.fromiter((i for x in lists for i in x), np.int32)))
        at = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        lengths = self.sizes[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        starts = np.cumsum(self.sizes) - self.sizes
        ids = self.ids[np.repeat(starts[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]


def slices(values: pa.Array, most: int = SLICE_CHARS) -> Iterator[pa.Array]:
    """Parts of a batch with about ``most`` bytes or list items each (one row at least), which bounds a worker's memory."""
    size = pa.compute.list_value_length if pa.types.is_list(values.type) else pa.compute.binary_length
    ends = np.cumsum(np.asarray(pa.compute.fill_null(size(values), 0), np.int64))
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield values.slice(at, to - at)
        at = to


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", id: str = "doc_id",
           and_decode: bool = False) -> DataFrame:
    """(doc_id, ids): the whole text's token ids. NULL and empty texts give no ids; special strings are plain text.

    ``and_decode`` adds ``bytes``, decoded from the ids by the same worker, which saves a second one.

    The vocabulary is read on the driver and broadcast; it is as large as its file. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.from_file(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                ids, offsets = encoder.encode(part.to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(0).slice(at, len(part)), lists]
                if and_decode:
                    columns.append(binary(*shared.value.decode(ids, offsets)))
                yield pa.RecordBatch.from_arrays(columns, [id, "ids", "bytes"][:len(columns)])
                at += len(part)

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"`{id}` {kind}, ids array<int>" + ", bytes binary" * and_decode)


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, buffers).cast(pa.binary())


def decode(rows: DataFrame, vocabulary_path: str) -> DataFrame:
    """Adds ``bytes`` to frames that have ``ids``. NULL ids give NULL, an unknown id ends the job."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.from_file(vocabulary_path))

    def part(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
        out = binary(*shared.value.decode(flat, np.concatenate(([0], np.cumsum(sizes)))))
        return pa.compute.if_else(lists.is_valid(), out, None)

    @F.arrow_udf("binary")
    def to_bytes(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(x) for x in slices(lists, SLICE_CHARS // 4)] or [pa.array([], pa.binary())])

    return rows.withColumn("bytes", to_bytes("ids"))


def digests(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the decoded bytes)."""
    rows = encode(docs, vocabulary_path, pattern, and_decode=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))
