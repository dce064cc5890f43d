"""Ranked lexical search by one automaton over the documents.

All terms of the stated items go into an Aho-Corasick automaton, each between two guard bytes; a document whose
separators have become guards then gives every occurrence of a whole term in one walk, without an index of
documents. The first walk counts documents, terms and document frequencies; the second scores each document for the items
its terms belong to and keeps, in each task, the best of each item. Items that share a walk are bounded by the bytes of
their terms; further ones take walks of their own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calzada.llm.bpe import slices
from calzada.sources.workspace import materialise

# A term is a maximal run of characters outside these ASCII ranges.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GUARD = "\0"
# Bytes of distinct terms that share an automaton, and items that share a walk.
TERM_BYTES, ITEMS = 1 << 22, 20_000
# Scores and counts held at once, and candidates kept before they are cut to the best of each item.
CELLS, COUNTS, WAITING = 1 << 21, 1 << 18, 1 << 18
NOBODY = np.iinfo(np.int64).max


def _folded() -> bytes:
    """Byte by byte: A-Z lowered, other ASCII but digits and letters made the guard, the rest as it is."""
    table = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        table[i] = ord(c.lower()) if c.isalnum() else 0
    return bytes(table)


FOLDED = _folded()


def terms_of(text: Column) -> Column:
    """The terms of a text, repeats included."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


class Scanner:
    """Counts the automaton's terms in documents, given as UTF-8 bytes."""

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            # One character stands for one byte, as in the documents below.
            self.automaton.add_word(GUARD + term.encode().decode("latin-1") + GUARD, i)
        if terms:
            self.automaton.make_automaton()
        self.some = bool(terms)

    def count(self, text: bytes | None) -> tuple[int, dict[int, int]]:
        """(number of terms, times each term of the automaton occurs)."""
        if not text:
            return 0, {}
        guarded = b"\0" + text.translate(FOLDED) + b"\0"
        inside = np.frombuffer(guarded, np.uint8) != 0
        n = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
        if not n or not self.some:
            return n, {}
        return n, Counter(map(itemgetter(1), self.automaton.iter(guarded.decode("latin-1"))))


class Best:
    """The best documents of each item: highest score first, then smaller doc_id, NULL last."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.item, self.score, self.id, self.known = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.zeros(items, np.int64)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Scores of some documents (rows) for all items (columns)."""
        at, item = np.nonzero((scores > 0) & (scores >= self.least))
        self.waiting.append((item, scores[at, item], ids[at], known[at]))
        self.held += len(at)
        if self.held > WAITING:
            self.cut()

    def cut(self) -> None:
        parts = [(self.item, self.score, self.id, self.known), *self.waiting]
        self.item, self.score, self.id, self.known = map(np.concatenate, zip(*parts))
        self.waiting, self.held = [], 0
        order = np.lexsort((self.id, 1 - self.known, -self.score, self.item))
        own = self.item[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        order = order[place < self.k]
        self.item, self.score, self.id, self.known = (x[order] for x in (self.item, self.score, self.id, self.known))
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[:] = 0
        self.least[self.item[last]] = self.score[last]


def _walk_counts(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms.value)
        docs = total = 0
        holding: Counter = Counter()
        for batch in batches:
            for part in slices(batch["text"]):
                for text in part.to_pylist():
                    n, found = scanner.count(text)
                    docs, total = docs + (n > 0), total + n
                    holding.update(found.keys())
        # -1 and -2 stand for the documents with a term and for all their terms.
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, -2, *holding], pa.int64()), "n": pa.array([docs, total, *holding.values()], pa.int64())})
    return run


def _walk_scores(terms, weights, owners, n_docs: int, n_terms: int, k: int):
    """``owners``: for each term, where its items start in the list of items, and that list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, weight, (starts, items, n_items) = Scanner(terms.value), weights.value, owners.value
        best, many = Best(n_items, k), max(1, CELLS // max(1, n_items))
        held: list = []

        def score() -> None:
            table = np.zeros((len(held), n_items), np.int64)
            for row, (_, n, found) in enumerate(held):
                m = 100 - 90 + 90 * n * n_docs // n_terms
                own = np.fromiter(found.keys(), np.int64, len(found))
                tf = np.fromiter(found.values(), np.int64, len(found))
                gain = weight[own] * (1_000_000_000 * tf // (1_000 * tf + 8 * m))
                sizes = starts[own + 1] - starts[own]
                at = np.arange(int(sizes.sum())) + np.repeat(starts[own] - (np.cumsum(sizes) - sizes), sizes)
                np.add.at(table[row], items[at], np.repeat(gain, sizes))
            ids = np.array([NOBODY if id is None else id for id, _, _ in held], np.int64)
            best.add(table, ids, np.array([id is not None for id, _, _ in held], np.int64))
            held.clear()

        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            done = counts = 0
            for part in slices(batch["text"]):
                for text in part.to_pylist():
                    n, found = scanner.count(text)
                    if found:
                        held.append((ids[done], n, found))
                    done, counts = done + 1, counts + len(found)
                    if len(held) >= many or counts > COUNTS:
                        score()
                        counts = 0
        if held:
            score()
        best.cut()
        yield pa.RecordBatch.from_pydict({"item": pa.array(best.item, pa.int64()), "score": pa.array(best.score, pa.int64()),
                                          "doc_id": pa.array(best.id, pa.int64(), mask=best.known == 0)})
    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, term_bytes: int = TERM_BYTES, items_to_a_walk: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, ties to the smaller doc_id.

    Each row of ``docs`` is a document and each different row (item_id, text) of ``items`` an item; ids may be NULL (a document
    without one comes last among equals) or repeat. NULL and empty texts have no terms. Empty tables give no rows. Other columns are
    ignored. The items meet the documents in walks of at most ``items_to_a_walk`` items, or about so many, and ``term_bytes`` bytes of
    terms; the terms of one walk go through the driver, and an item with more terms than that has a walk to itself.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).where("text IS NOT NULL")
    stated = items.select(F.col("item_id").cast("long"), F.array_distinct(terms_of(F.col("text"))).alias("terms"), "text")
    stated = stated.where(F.size("terms") > 0).dropDuplicates(["item_id", "text"]).withColumn("item", F.monotonically_increasing_id())
    own_bytes = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t))
    stated = materialise(stated.select("item", "item_id", "terms", own_bytes.alias("bytes")), "search-items")
    size = stated.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("bytes") <= term_bytes, F.col("bytes"))), F.lit(0)).alias("bytes")).first()
    walks = max(1, -(-size.n // items_to_a_walk), -(-2 * size.bytes // term_bytes) if size.bytes > term_bytes else 1)
    small = stated.where(F.col("bytes") <= term_bytes)
    parts = [small if walks == 1 else small.where(F.pmod(F.xxhash64("item"), F.lit(walks)) == w) for w in range(walks)]
    parts += [stated.where(F.col("item") == r.item) for r in stated.where(F.col("bytes") > term_bytes).select("item").toLocalIterator()]
    found = [one for part in parts if (one := _walk(spark, docs, part, k)) is not None]
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    found = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(stated.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _walk(spark, docs: DataFrame, stated: DataFrame, k: int) -> DataFrame | None:
    """The best documents found by each task for the items of one walk; None without items."""
    rows = stated.select("item", "terms").toArrow().sort_by("item")
    if not rows.num_rows:
        return None
    lists = rows["terms"].combine_chunks()
    flat = lists.flatten().dictionary_encode()
    terms, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    place = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
    order = np.lexsort((place, codes))
    starts = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(terms)))))
    shared = spark.sparkContext.broadcast(terms)
    counts = docs.select("text").mapInArrow(_walk_counts(shared), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counted = {r.term: r.n for r in counts.collect()}
    n_docs, n_terms = counted.pop(-1, 0), counted.pop(-2, 0)
    if not counted:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counted.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
    owners = spark.sparkContext.broadcast((starts, place[order], rows.num_rows))
    run = _walk_scores(shared, spark.sparkContext.broadcast(weight), owners, n_docs, n_terms, k)
    best = docs.mapInArrow(run, "item bigint, score bigint, doc_id bigint")
    # Tasks number the items of a walk from 0.
    names = materialise(spark.createDataFrame(pa.table({"number": pa.array(range(rows.num_rows), pa.int64()), "row": rows["item"]})), "search-walk")
    return best.join(names, F.col("item") == F.col("number")).select(F.col("row").alias("item"), "score", "doc_id")
