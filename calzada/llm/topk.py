"""Exact top-k inner products with M-trees.

Vectors are made whole numbers. Inner product becomes a metric by one more component that gives all vectors of a tree
the same norm: then the nearest vectors are those with the largest product. The vectors are dealt into chunks of bounded
size; a task builds the paged M-tree of a chunk and searches it best first for a block of the stated queries. Nodes
keep a covering radius and the distance to their parent's centre, so that the triangle inequality spares most distances
of far pages. Results are exact: bounds are rounded towards the query, products are whole numbers, ties go to
the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calzada.sources.workspace import materialise

LEAF, FAN = 512, 16
EXACT = 2 ** 53
# Squared length of whole vectors up to which every product fits in 64 bits.
LARGEST = 2.0 ** 62


class Node:
    """A page. ``centre``, ``radius`` and ``up`` (distance to the parent's centre) bound what is below it."""

    __slots__ = ("centre", "radius", "up", "low", "children", "rows", "apart")

    def __init__(self, centre: np.ndarray, up: float):
        self.centre, self.up, self.radius, self.low = centre, up, 0.0, 0
        self.children: list[Node] | None = None
        self.rows = self.apart = None


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[order], vectors[order]
        norms = (self.whole.astype(np.float64) ** 2).sum(axis=1)
        self.norm = float(norms.max(initial=0.0))
        self.points = np.column_stack((self.whole.astype(np.float64), np.sqrt(self.norm - norms)))
        # Products below 2**53 are exact as floating point, which is faster.
        self.data = self.whole.astype(np.float64) if self.norm < EXACT / 4 else self.whole
        self.leaf, self.fan, self.rng = leaf, fan, np.random.default_rng(0)
        self.computed = 0
        self.root = self._build(np.arange(len(ids)), self.points[0], 0.0) if len(ids) else None

    def _build(self, rows: np.ndarray, centre: np.ndarray, up: float) -> Node:
        node = Node(centre, up)
        apart = np.sqrt(((self.points[rows] - centre) ** 2).sum(axis=1))
        node.radius, node.low = float(apart.max()), int(self.ids[rows[0]])
        if len(rows) <= self.leaf:
            node.rows, node.apart = rows, apart
            return node
        fan = min(self.fan, -(-len(rows) // self.leaf))
        centres = self.points[self.rng.choice(rows, fan, replace=False)]
        near = (self.points[rows] ** 2).sum(axis=1)[:, None] - 2 * self.points[rows] @ centres.T + (centres ** 2).sum(axis=1)
        own = near.argmin(axis=1)
        parts = [rows[own == i] for i in range(fan)]
        if max(map(len, parts)) == len(rows):  # copies of one vector: cut by id
            parts = np.array_split(rows, fan)
        node.children = [self._build(part, c, float(np.sqrt(((c - centre) ** 2).sum()))) for part, c in zip(parts, centres) if len(part)]
        return node

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """[(score, id)] of the k best other rows: highest score first, then smaller id."""
        q = np.append(query.astype(np.float64), 0.0)
        size = float((q ** 2).sum())
        slack = 1e-6 + 1e-9 * (size + self.norm)
        wide = float(np.sqrt(size + self.norm)) * 1e-7
        probe = query.astype(self.data.dtype) if self.data.dtype == np.float64 and size < EXACT / 4 else query
        data = self.data if probe.dtype == self.data.dtype else self.whole
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst is first

        def bound(least):
            """The highest whole product of a point that is at least so far away."""
            least = np.maximum(least - wide, 0.0)
            return np.floor((size + self.norm - least * least) / 2 + slack)

        def hopeless(most: float, low: int) -> bool:
            return len(best) == k and (most < best[0][0] or most == best[0][0] and low > -best[0][1])

        if self.root is None:
            return []
        at = float(np.sqrt(((q - self.root.centre) ** 2).sum()))
        queue = [(-float(bound(at - self.root.radius)), 0, at, self.root)]
        pushed = 0
        while queue:
            most, _, at, node = heapq.heappop(queue)
            if hopeless(-most, -(1 << 63)):
                break
            if hopeless(-most, node.low):
                continue
            if node.children is None:
                rows = node.rows
                if len(best) == k:
                    rows = rows[bound(np.abs(at - node.apart)) >= best[0][0]]
                scores = data[rows] @ probe
                self.computed += len(rows)
                if len(best) == k:
                    keep = scores >= best[0][0]
                    rows, scores = rows[keep], scores[keep]
                # However many rows bear the query's own id, none of them may take a candidate's place.
                keep = self.ids[rows] != own
                rows, scores = rows[keep], scores[keep]
                if len(rows) > 4 * k:
                    cut = np.lexsort((self.ids[rows], -scores))[:k]
                    rows, scores = rows[cut], scores[cut]
                for score, id in zip(scores.tolist(), self.ids[rows].tolist()):
                    item = (int(score), -id)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                continue
            for child in node.children:
                if hopeless(float(bound(abs(at - child.up) - child.radius)), child.low):
                    continue
                to = float(np.sqrt(((q - child.centre) ** 2).sum()))
                self.computed += 1
                top = float(bound(to - child.radius))
                if not hopeless(top, child.low):
                    pushed += 1
                    heapq.heappush(queue, (-top, pushed, to, child))
        return [(score, -id) for score, id in sorted(best, key=lambda x: (-x[0], -x[1]))]


def whole_vector(scale: int = 64, column: str = "embedding") -> Column:
    return F.transform(column, lambda x: F.floor(scale * x.cast("double")).cast("long"))


def usable(column: str = "embedding") -> Column:
    """No NULL vector, no NULL or non-finite component."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def top_products(vectors: DataFrame, query_every: int = 20, k: int = 20, scale: int = 64, chunk: int = 16_384,
                 block: int = 4_096) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose vec_id is divisible by ``query_every``, against all others.

    Unusable vectors (NULL, or with a NULL or non-finite component) and NULL ids take no part; vectors of different
    length are not compared. A repeated row is a candidate for each time it occurs, but no row with the query's own id is.
    An empty table gives no rows. Other columns are ignored. The stated queries meet the chunks in blocks. Vectors whose
    products may pass 64 bits end the call with an OverflowError, whether or not they would be among the best.
    """
    # The number, once written, deals rows into chunks; a repeated id does not fall into one chunk whole.
    rows = materialise(vectors.where(usable()).where("vec_id IS NOT NULL").select(
        F.col("vec_id").cast("long"), whole_vector(scale).alias("v"), F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("row"),
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(scale * x.cast("double")).cast("double"), 2.0)).alias("norm")), "topk-vectors")
    draw = F.xxhash64("row", F.lit("chunk"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % query_every == 0).alias("q"), F.max("norm").alias("norm")).first()
    if (counts.norm or 0.0) >= LARGEST * (1 - 1e-9):
        raise OverflowError("products of these vectors do not fit in 64 bits")
    chunks, blocks = max(1, -(-counts.n // chunk)), max(1, -(-counts.q // block))
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    left = rows.select("dim", F.pmod(draw, F.lit(chunks)).cast("int").alias("c"), F.explode(every(blocks)).alias("b"), "vec_id", "v")
    right = rows.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "v"]).select(
        "dim", F.explode(every(chunks)).alias("c"), F.pmod(draw, F.lit(blocks)).cast("int").alias("b"), "vec_id", "v")

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = table["v"].combine_chunks().flatten().to_numpy()
        return table["vec_id"].to_numpy(), flat.reshape(table.num_rows, -1)

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if candidates.num_rows and queries.num_rows:
            tree = MTree(*matrix(candidates))
            for number, (own, query) in enumerate(zip(*matrix(queries))):
                found += [(int(own), query.tobytes(), id, score) for score, id in tree.search(query, int(own), k)]
        columns = list(zip(*found)) if found else [(), (), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "query": pa.array(columns[1], pa.binary()),
                         "vec_id": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.int64())})

    keys = ["dim", "c", "b"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id bigint, query binary, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
