"""Hard negatives by exact products in a residue number system.

Whole-number vectors are split into residues modulo small primes, centred around zero. Each residue matrix is multiplied in
float32: with at most ``DEPTH`` components at a time no partial sum reaches 2**24, so every sum is exact. Chinese
remaindering (mixed radix) puts the residues of a product together again, signed; as many primes are taken as the
norms of the two blocks demand. Anchors meet the rows in blocks, twice: first for their best rows of the same label,
then for the best rows of other labels within the window that each of those gives.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calzada.llm.topk import usable, whole_vector
from calzada.sources.workspace import materialise

# Primes below 512: residues lie within 254, and 254**2 * 256 < 2**24.
PRIMES = tuple(p for p in range(511, 2, -2) if all(p % d for d in range(3, 23, 2)))[:7]
DEPTH = 256
# Products must stay below this size for seven primes to tell them apart.
LARGEST = math.prod(PRIMES) // 2
# Cells of one slice of the table of products, and components of one block of vectors.
SLICE, BLOCK = 1 << 21, 1 << 20


def primes_for(bound: int) -> tuple[int, ...]:
    """The fewest primes whose product tells all whole numbers of at most this size apart."""
    taken, reach = 0, 1
    while reach <= 2 * bound + 1:
        if taken == len(PRIMES):
            raise OverflowError("products of these vectors do not fit in 64 bits")
        reach *= PRIMES[taken]
        taken += 1
    return PRIMES[:taken]


def residues(whole: np.ndarray, prime: int) -> np.ndarray:
    """Remainders between -prime/2 and prime/2 as float32."""
    left = whole % prime
    return np.where(left > prime // 2, left - prime, left).astype(np.float32)


def joined(parts: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed numbers with these residues, digit by digit of the mixed radix system of the primes."""
    total, radix, digits = np.zeros(parts[0].shape, np.int64), 1, []
    for i, (prime, part) in enumerate(zip(primes, parts)):
        digit = part.astype(np.int64)
        weight = 1
        for known, before in zip(digits, primes):
            digit -= known * weight % prime
            weight = weight * before % prime
        digits.append(digit % prime * pow(weight, -1, prime) % prime)
        total += digits[i] * radix
        radix *= prime
    return np.where(total > radix // 2, total - radix, total)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The exact products of the rows of two whole-number matrices."""
    norms = [float((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)) for m in (left, right)]
    primes = primes_for(int(math.sqrt(norms[0]) * math.sqrt(norms[1]) * (1 + 1e-9)) + 1)
    parts = []
    for prime in primes:
        a, b = residues(left, prime), residues(right, prime)
        total = np.zeros((len(left), len(right)), np.int32)
        for start in range(0, left.shape[1], DEPTH):
            total += (a[:, start:start + DEPTH] @ b[:, start:start + DEPTH].T).astype(np.int32) % prime
            total %= prime
        parts.append(total)
    return joined(parts, primes)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each row, equal scores by column."""
    least = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, least)
    if masked.shape[1] > k:
        cut = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
        allowed = allowed & (masked >= cut[:, None])
    at, column = np.nonzero(allowed)
    order = np.lexsort((column, -scores[at, column], at))
    at, column = at[order], column[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], column[keep]


class Block:
    """Vectors of one cell: rows ordered by id, so that earlier columns win ties."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("vec_id")
        self.table, self.ids, self.labels = table, table["vec_id"].to_numpy(), table["label"].to_numpy()
        flat = table["v"].combine_chunks().flatten().to_numpy()
        self.vectors = flat.reshape(table.num_rows, -1) if len(flat) else np.zeros((table.num_rows, 0), np.int64)

    def against(self, rows: Block):
        """Slices of the product table: (first anchor, scores, same label, other id)."""
        step = max(1, SLICE // max(1, len(rows.ids)))
        for start in range(0, len(self.ids), step):
            part = slice(start, start + step)
            yield (start, products(self.vectors[part], rows.vectors), self.labels[part, None] == rows.labels[None, :],
                   self.ids[part, None] != rows.ids[None, :])


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if rows.num_rows and anchors.num_rows:
            left, right = Block(anchors), Block(rows)
            number = left.table["anchor"].to_numpy()
            for start, scores, same, other in left.against(right):
                at, column = best(scores, same & other, k)
                out.append((number[start + at], right.ids[column], scores[at, column]))
        return pa.table(dict(zip(("anchor", "positive_id", "positive_score"), map(np.concatenate, zip(*out)))))
    return run


def _negatives(k: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 5]
        if rows.num_rows and anchors.num_rows:
            left, right = Block(anchors), Block(rows)
            number = left.table["anchor"].to_numpy()
            lists = left.table["positives"].to_pylist()
            for start, scores, same, _ in left.against(right):
                own = lists[start:start + len(scores)]
                for place in range(max(map(len, own))):
                    # Window ends as whole numbers: ceil(low * p / 100) and floor(high * p / 100).
                    chosen = np.array([i for i, x in enumerate(own) if len(x) > place], np.int64)
                    found = [own[i][place] for i in chosen]
                    bottom = np.array([-(-low * p["positive_score"] // 100) for p in found], np.int64)[:, None]
                    top = np.array([high * p["positive_score"] // 100 for p in found], np.int64)[:, None]
                    part = scores[chosen]
                    at, column = best(part, ~same[chosen] & (part >= bottom) & (part <= top), k)
                    out.append((number[start + chosen[at]], np.full(len(at), place), right.ids[column], part[at, column],
                                np.array([p["positive_id"] for p in found], np.int64)[at]))
        return pa.table(dict(zip(("anchor", "place", "negative_id", "negative_score", "positive_id"), map(np.concatenate, zip(*out)))))
    return run


def hard_negatives(vectors: DataFrame, label: Column, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row whose vec_id is divisible by ``anchor_every``.

    For each anchor and each of its best other rows of the same label: the best rows of other labels whose score is between
    ``low`` and ``high`` hundredths of that row's. Rows without vec_id, label or a whole finite vector take no part; vectors
    of different length do not meet. A repeated row counts each time as positive or negative and once as an anchor; no row with
    the anchor's own id is its positive. Vectors whose products pass 3e18 end the call with an OverflowError.
    An empty table gives no rows. Other columns are ignored. ``block`` bounds the components that meet in one task.
    """
    rows = materialise(vectors.where(usable()).select(
        F.col("vec_id").cast("long"), label.cast("long").alias("label"), whole_vector(scale).alias("v"), F.size("embedding").alias("dim"),
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(scale * x.cast("double")).cast("double"), 2.0)).alias("norm"),
        F.monotonically_increasing_id().alias("row")).where("vec_id IS NOT NULL AND label IS NOT NULL"), "negatives-vectors")
    is_anchor = F.col("vec_id") % anchor_every == 0
    anchors = materialise(rows.where(is_anchor).dropDuplicates(["vec_id", "label", "v"]).select(
        "vec_id", "label", "v", "dim", F.monotonically_increasing_id().alias("anchor")), "negatives-anchors")
    size = rows.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.coalesce(F.max("dim"), F.lit(0)).alias("dim")).first()
    if (size.norm or 0.0) >= LARGEST * (1 - 1e-9):
        raise OverflowError("products of these vectors do not fit in 64 bits")
    per_block = max(1, block // max(1, size.dim))
    chunks, blocks = (max(1, -(-n // per_block)) for n in (size.n, anchors.count()))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.select("dim", cell("row", chunks).alias("c"), every(blocks).alias("b"), "vec_id", "label", "v")
    keys = ["dim", "c", "b"]

    def met(stated: DataFrame, run, schema: str) -> DataFrame:
        right = stated.select(every(chunks).alias("c"), cell("anchor", blocks).alias("b"), "*")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)

    near = met(anchors, _positives(positives), "anchor bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    near = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    anchors = materialise(anchors.join(near, "anchor"), "negatives-positives")
    far = met(anchors, _negatives(negatives, low, high),
              "anchor bigint, place bigint, negative_id bigint, negative_score bigint, positive_id bigint")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    stated = anchors.select("anchor", F.col("vec_id").alias("anchor_id"), F.explode("positives").alias("p"))
    stated = stated.select("anchor", "anchor_id", (F.col("p.place") - 1).cast("long").alias("place"), F.col("p.positive_score").alias("positive_score"))
    return far.join(stated, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
