"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that go together are put in one partition. If the partitions' thresholds add up to (limit - partitions + 1),
any two fingerprints within the limit agree, in at least one partition, up to that partition's threshold. The thresholds
may differ and a partition may be left out; a dynamic programme picks those with the least estimated work. Equal
keys bring candidates together and every candidate is verified. The choice affects the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calzada.llm.bpe import slices
from calzada.llm.components import components
from calzada.sources.workspace import materialise

BITS = 64
SAMPLE = 4_096
BLOCK = 4_096
# Estimated microseconds for a probed key and for a verified candidate.
PROBE_COST, VERIFY_COST = 2.0, 0.01


def fingerprint(text: bytes | None, words: int = 4) -> list[int]:
    """Hashes of the shingles of a text, repeats included: A-Z lowered, split at space and tab to carriage return."""
    parts = (text or b"").lower().split()
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), 42)] if parts else []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1:].tolist())]


def _fold(hashes: list[list[int]]) -> np.ndarray:
    """One fingerprint for each list: bits set in over half of it; zero for an empty list."""
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    if counts.sum():
        flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(counts.sum()))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[full]
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * votes > counts[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, words: int = 4, digest: Column | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and digest if asked for; NULL and blank texts have fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_fold([fingerprint(t, words) for t in part.to_pylist()]) for part in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(done) if done else [], pa.int64()), *batch.columns[2:]], ["doc_id", "fp", "digest"][:batch.num_columns])

    more = [] if digest is None else [digest.alias("digest")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *more).mapInArrow(run, "doc_id bigint, fp bigint" + ", digest bigint" * len(more))


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0-63 in ``parts`` groups: each starts with a bit that is free and takes those most correlated with it."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    centred = bits.astype(np.float64) - bits.sum(axis=0) / max(1, len(bits))
    scale = np.sqrt((centred ** 2).sum(axis=0)) + 1e-9
    like = np.abs(centred.T @ centred) / np.outer(scale, scale)
    free, out = list(range(BITS)), []
    for left in range(parts, 0, -1):
        group = [free.pop(0)]
        while len(group) < (len(free) + len(group)) // left:
            best = max(free, key=lambda b: (like[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds of least cost with the given sum; ``costs[i][t + 1]`` is the cost of threshold t, -1 leaves i out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t, extra in enumerate(row, -1):
                if done + t not in step or cost + extra < step[done + t][0]:
                    step[done + t] = (cost + extra, [*chosen, t])
        best = step
    return best[total][1]


def plan(sample: np.ndarray, n: int, limit: int, part_counts: tuple[int, ...] = (2, 3, 4, 5)) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] for the number of partitions whose estimated work is least."""
    choices = []
    half = len(sample) // 2
    one, two = (sample[:half], sample[half:2 * half]) if half else (np.zeros(1, np.uint64), np.full(1, 2 ** 64 - 1, np.uint64))
    rolled = [np.roll(two, s) for s in range(min(64, len(two)))]
    for parts in part_counts:
        groups = group_bits(sample, parts)
        costs = []
        for group in groups:
            mask = np.uint64(mask_of(group))
            apart = np.concatenate([np.bitwise_count((one ^ r) & mask) for r in rolled])
            row = [0.0]
            for t in range(limit + 1):
                keys = sum(comb(len(group), k) for k in range(t + 1))
                # A rate that the sample cannot show is taken as that of independent fair bits.
                rate = max(float((apart <= t).mean()), keys / 2.0 ** len(group))
                row.append(n * keys * PROBE_COST + float(n) * n * rate * VERIFY_COST)
            costs.append(row)
        chosen = allocate(costs, limit - parts + 1)
        work = sum(row[t + 1] for row, t in zip(costs, chosen))
        choices.append((work, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def keys(fps: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, probe): a fingerprint's own key in each partition, and as probes all keys within its threshold."""
    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    rows = None
    for part, (bits, threshold) in enumerate(chosen):
        flips = [signed(mask_of(list(c))) for k in range(1, threshold + 1) for c in combinations(bits, k)]
        own = F.col("fp").bitwiseAND(F.lit(signed(mask_of(bits))))
        table = F.array(F.lit(0), *map(F.lit, flips)).cast("array<bigint>")
        made = fps.select(F.lit(part).alias("part"), own.alias("own"), "fp", F.explode(table).alias("flip"))
        made = made.select("part", F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "fp", (F.col("flip") != 0).alias("probe"))
        rows = made if rows is None else rows.unionByName(made)
    return rows


def _forest(fp: np.ndarray, probe: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within a bucket, none to spare: breadth first, each row is reached once."""
    linked = np.zeros(len(fp), bool)
    for at in range(0, len(fp), 256):
        near = (np.bitwise_count(fp[at:at + 256, None] ^ fp[None, :]) <= limit) & ~(probe[at:at + 256, None] & probe[None, :])
        linked[at:at + 256] = near.sum(axis=1) > ~probe[at:at + 256]
    left, out = np.flatnonzero(linked), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            node = front.pop()
            near = np.bitwise_count(fp[left] ^ fp[node]) <= limit
            if probe[node]:
                near &= ~probe[left]
            out += [(node, x) for x in left[near].tolist()]
            front += left[near].tolist()
            left = left[~near]
    return out


def _links_of(part: np.ndarray, key: np.ndarray, fp: np.ndarray, probe: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys. Small buckets are compared row by row together, large ones on their own."""
    change = np.concatenate(([True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])))
    starts = np.flatnonzero(change)
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    bucket = np.cumsum(change) - 1
    small = (sizes <= 16)[bucket]
    a, b = [], []
    for shift in range(1, 16):
        i = np.flatnonzero(small[:-shift] & (bucket[:-shift] == bucket[shift:])) if shift < len(key) else np.zeros(0, np.int64)
        if not len(i):
            break
        j = i + shift
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= limit) & ~(probe[i] & probe[j])
        a.append(fp[i[near]])
        b.append(fp[j[near]])
    for start, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
        own = fp[start:start + size]
        found = np.array(_forest(own, probe[start:start + size], limit), np.int64).reshape(-1, 2)
        a.append(own[found[:, 0]])
        b.append(own[found[:, 1]])
    one, two = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
    return one[one != two], two[one != two]


def bucket_links(rows: DataFrame, limit: int, block: int = BLOCK) -> DataFrame:
    """(a, b) fingerprints within the limit that share a key; a bucket's links connect what is connected in it.

    Buckets over ``block`` rows are cut into blocks that meet in pairs, each pair a bucket of its own, so
    no task holds more than two blocks of one bucket.
    """
    large = rows.groupBy("part", "key").count().where(F.col("count") > block).select(
        "part", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    large = materialise(large, "simhash-large")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j"))))
    spread = (rows.join(large, ["part", "key"], "left").withColumn("mine", own)
              .select("part", "key", "fp", "probe", F.explode(pairs).alias("pair")))
    # Two blocks' numbers and the partition in one number: below 2**28 blocks to a bucket.
    spread = spread.select((F.col("part").cast("long") * (1 << 56) + F.col("pair.i") * (1 << 28) + F.col("pair.j")).alias("part"), "key", "fp", "probe")
    dealt = spread.repartition("part", "key").sortWithinPartitions("part", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            part, key = now[0], now[1]
            if not len(key):
                continue
            # The last bucket may go on in the next batch.
            open_ = int(np.flatnonzero((part != part[-1]) | (key != key[-1]))[-1]) + 1 if (part[0], key[0]) != (part[-1], key[-1]) else 0
            rest = [x[open_:] for x in now]
            if open_:
                yield links(*[x[:open_] for x in now])
        if rest is not None and len(rest[0]):
            yield links(*rest)

    def links(part, key, fp, probe):
        a, b = _links_of(part, key, fp.view(np.uint64), probe.astype(bool), limit)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def linked(prints: DataFrame, limit: int, block: int) -> DataFrame:
    """(fp, first, root) of every fingerprint of the written table (doc_id, fp): its smallest doc_id and its component."""
    fps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    n = fps.count()
    # For the plan only: a bounded sample.
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    chosen = plan(sample, n, limit)
    links = bucket_links(materialise(keys(fps, chosen), "simhash-keys"), limit, block)
    roots = components(links)
    return materialise(fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, limit: int = 4, words: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that can be reached) of every row.

    NULL, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows are copies.
    A NULL doc_id is kept, and is a component_id only if nothing else can be reached. An empty table gives no
    rows. Other columns are ignored.
    """
    prints = materialise(fingerprints(docs, words), "simhash-prints")
    placed = linked(prints, limit, block)
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = placed.join(smallest, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, limit: int = 4, words: int = 4) -> DataFrame:
    """One row of each component: that of the smallest doc_id (NULL last), whatever else bears it. Columns as they come."""
    # Texts under one doc_id are told apart by their digests; rows that repeat both are copies of one row.
    digest = F.xxhash64(F.col("text").cast("binary"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("digest"))
    prints = materialise(fingerprints(docs, words, digest), "simhash-prints")
    placed = linked(prints, limit, BLOCK).select("fp", "root")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")
    kept = prints.join(placed, "fp").groupBy("root").agg(F.min(place).alias("best")).select("best.*").select(key.alias("key"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long"), digest.alias("digest")).select("doc", key.alias("key"))
    # The second step reuses the join's partitioning; it matters only for rows that repeat an identifier.
    return rows.join(kept, "key", "left_semi").groupBy("key").agg(F.first("doc").alias("doc")).select("doc.*")
