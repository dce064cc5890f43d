"""Quality scores from supervised subword embeddings.

A document is the average of the learned vectors of its words, of the character n-grams inside them (both hashed
into a table of fixed size) and of one vector for every word that repeats the word before it; a softmax layer turns it into a label. Vectors and layer are trained together by
stochastic gradient descent in numpy. Because the layer is linear, a trained model is stored as one
number per bucket (its vector times the layer), and a document's score is the average of those.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calzada.llm.bpe import KEPT_TOKENS, SLICE_CHARS, slices
from calzada.llm.language import held_out
from calzada.sources.workspace import materialise

BUCKETS, GRAMS = 1 << 16, (3, 4, 5)
DIM, EPOCHS, RATE = 8, 6, 0.5
# Labelled documents that are looked at, at most, and (bucket, share) pairs of all of them together, in the order of a draw.
SAMPLES, PAIRS = 2_048, 16_000_000
# Characters to a step of hashing; words longer than LONG are not kept.
PLACES, LONG = 1 << 16, 64
# The bucket of words that repeat the one before.
SAME = crc32(b"<same>") % BUCKETS
BLANK = re.compile(r"\s")


def words_of(text: str | None, most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The words of a text, in lists of about ``most`` characters that are cut between words."""
    text, at = text or "", 0
    while at < len(text):
        blank = BLANK.search(text, at + most)
        end = blank.start() if blank else len(text)
        yield text[at:end].split()
        at = end


def word_hashes(words: list[str]) -> np.ndarray:
    """A 32-bit hash of each word as a whole; its bucket is the remainder."""
    return np.fromiter((crc32(w.encode()) for w in words), np.uint64, len(words))


def repeats(hashes: np.ndarray) -> int:
    """How many words repeat the word before them."""
    return int((hashes[1:] == hashes[:-1]).sum())


def groups(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first word, words) of about PLACES characters; a longer word is a group by itself."""
    first, held = 0, 0
    for k, word in enumerate(words):
        if held and held + len(word) > PLACES:
            yield first, words[first:k]
            first, held = k, 0
        held += len(word) + 2
    if held:
        yield first, words[first:]


def grams(words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first word, number of words, word of each n-gram counted from there, its bucket), at most PLACES n-grams at a time.

    Words get marks at both ends. The characters are hashed as numbers, all places at once.
    """
    reach = max(GRAMS) - 1
    for first, group in groups(words):
        marked = "".join([f"<{w}>" for w in group])
        ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 2)
        for at in range(0, len(marked), PLACES):
            codes = np.frombuffer((marked[at:at + PLACES + reach] + "\0" * reach).encode("utf-32-le"), "<u4").astype(np.uint64)
            places = np.arange(at, min(at + PLACES, len(marked)))
            word = np.searchsorted(ends, places, side="right")
            room = ends[word] - places
            for n in GRAMS:
                h = np.full(len(places), n, np.uint64)
                for i in range(n):
                    h = (h ^ codes[i:i + len(places)]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                whole = room >= n
                yield first, len(group), word[whole], (h[whole] % np.uint64(BUCKETS)).astype(np.int64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares, which add up to one; nothing for a text without words."""
    total, last = np.zeros(BUCKETS), np.zeros(0, np.uint64)
    for found in words_of(text):
        counts = Counter(found)
        words, times = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
        hashes = word_hashes(words)
        total += np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), times, BUCKETS)
        known = dict(zip(words, hashes.tolist()))
        run = np.concatenate((last, np.fromiter(map(known.__getitem__, found), np.uint64, len(found))))
        total[SAME] += repeats(run)
        last = run[-1:]
        for first, _, word, bucket in grams(words):
            total += np.bincount(bucket, times[first + word], BUCKETS)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), (total[ids] / max(1.0, total.sum())).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 1) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias) of the log odds of label 1, from (buckets, shares, label)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.uniform(-0.1, 0.1, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, shares, label = rows[i]
            rate = np.float32(RATE * (1 - done / steps))
            own = vectors[ids]
            hidden = shares @ own
            raw = layer @ hidden + bias
            odds = np.exp(raw - raw.max())
            error = odds / odds.sum()
            error[label] -= 1
            back = layer.T @ error
            layer -= rate * np.outer(error, hidden)
            bias -= rate * error
            # Shares are small; the step is scaled so that a document moves its vectors by the rate as a whole.
            vectors[ids] = own - (rate * min(len(ids), 50)) * shares[:, None] * back
            done += 1
    change = layer[1] - layer[0]
    return (vectors @ change).astype(np.float64), float(bias[1] - bias[0])


def learn(docs: DataFrame, labels: DataFrame, samples: int = SAMPLES, pairs: int = PAIRS) -> tuple[np.ndarray, float]:
    """A model from a bounded sample of labelled documents outside fold 0 of 5, the same on every run.

    Of several labels of one document the largest counts. Texts become (bucket, share) lists on the executors; of the
    ``samples`` documents, those first drawn come to the driver, as long as they hold at most ``pairs`` of them together.
    """
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(5, 0)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(samples)

    @F.arrow_udf("ids array<int>, shares array<float>")
    def to_features(texts: pa.Array) -> pa.Array:
        made = [features(t) for part in slices(texts) for t in part.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))], ["ids", "shares"])

    # Of several rows of one document one counts, picked on the executors.
    text = F.col("text").cast("string")
    own = docs.select("doc_id", text.alias("text")).where("text IS NOT NULL").join(chosen, "doc_id")
    own = own.groupBy("doc_id", "label").agg(F.max_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = own.select("doc_id", "label", to_features("text").alias("f")).select("doc_id", "label", "f.ids", "f.shares")
    rows = materialise(rows.withColumn("n", F.size("ids")), "quality-sample")
    sizes = rows.select("doc_id", "n").orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").collect()
    ends = np.cumsum([r.n for r in sizes])
    if len(ends) and ends[-1] > pairs:
        rows = rows.where(F.col("doc_id").isin([r.doc_id for r, end in zip(sizes, ends) if end <= pairs]))
    table = rows.toArrow().sort_by("doc_id")
    made = [(ids.values.to_numpy(), shares.values.to_numpy(), int(label == 1)) for ids, shares, label in
            zip(table["ids"], table["shares"], table["label"].to_pylist()) if len(ids)]
    return train(made)


class Scorer:
    """Scores texts; the sum of a word of up to LONG characters over its buckets is kept, up to a number of words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.sums, self.sizes, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def _learn(self, words: list[str]) -> None:
        """Sums and numbers of buckets of words that are not known yet."""
        hashes = word_hashes(words)
        sums, sizes = self.weights[(hashes % np.uint64(BUCKETS)).astype(np.int64)], np.ones(len(words))
        for first, n, word, bucket in grams(words):
            sums[first:first + n] += np.bincount(word, self.weights[bucket], n)
            sizes[first:first + n] += np.bincount(word, minlength=n)
        self.codes.update(zip(words, range(len(self.sums), len(self.sums) + len(words))))
        self.sums, self.sizes = np.concatenate((self.sums, sums)), np.concatenate((self.sizes, sizes))
        self.hashes = np.concatenate((self.hashes, hashes))

    def _add(self, lists: list[tuple[int, list[str]]], total: np.ndarray, size: np.ndarray) -> None:
        if len(self.sums) > KEPT_TOKENS // 2:
            self._forget()
        new = list(dict.fromkeys(w for _, words in lists for w in words if w not in self.codes))
        if new:
            self._learn(new)
        for i, words in lists:
            at = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
            # A text that comes in several lists may repeat a word across them, too.
            run = np.concatenate((self.last[1] if self.last[0] == i else self.hashes[:0], self.hashes[at]))
            same = repeats(run)
            total[i] += self.sums[at].sum() + same * self.weights[SAME]
            size[i] += self.sizes[at].sum() + same
            self.last = i, run[-1:]
        for word in new:
            if len(word) > LONG:
                del self.codes[word]

    def score(self, texts: list[str | None]) -> np.ndarray:
        total, size = np.zeros(len(texts)), np.zeros(len(texts))
        lists, held, self.last = [], 0, (-1, None)
        for i, text in enumerate(texts):
            # A text's sum is made of its own lists, so it does not depend on the texts beside it.
            for words in words_of(text):
                lists.append((i, words))
                held += len(words)
                if held > KEPT_TOKENS // 2:
                    self._add(lists, total, size)
                    lists, held = [], 0
        self._add(lists, total, size)
        return 1 / (1 + np.exp(-(total / np.maximum(size, 1) + self.bias)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> Column:
    """Probability of label 1 for the whole text; NULL and blank texts get what the bias alone gives."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            done = [scorer.score(part.to_pylist()) for part in slices(batch, SLICE_CHARS)]
            yield pa.array(np.concatenate(done) if done else [], pa.float64())

    return scored(F.col(text).cast("string"))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out (fold 0 of 5), score, predicted for every row.

    Without labels the score is near a half. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    model = learn(docs, labels.select("doc_id", "quality"))
    rows = docs.select("doc_id", held_out(5, 0).alias("held_out"), score(docs, model).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
