"""Exact quantiles of several columns in two scans, from mergeable sketches.

The first scan keeps a sketch of each column; it brackets every wanted rank by two values of the column. The second counts what
lies below and at the ends of each bracket, and brings only the values strictly inside, a bounded number; where the sketch
leaves more than that inside, they get a sketch of their own and one scan more. Nothing is written, shuffled
or widened; results are exact, whatever the values and however good the sketch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sketch's rank error as a share of the rows, its points when a bracket is narrowed, and values brought to the driver for one bracket.
ERROR, POINTS, INSIDE = 1 / 5_000, 50, 20_000
Points = list[tuple[float, float]]


@dataclass
class Bracket:
    """Some wanted ranks of a column in a group, and the values they lie between."""

    group: object
    column: str
    ranks: list[int]
    low: float
    high: float
    inside: int
    total: int
    found: dict[int, float] = field(default_factory=dict)

    def narrow(self, below: int, at_low: int, inside: int, at_high: int, values: list[float], points: Points) -> None:
        """Settle the ranks that the counts decide; bracket the others by what lies inside."""
        first, last = below + at_low, below + at_low + inside
        for rank in self.ranks:
            if below <= rank < first:
                self.found[rank] = self.low
            elif last <= rank < last + at_high:
                self.found[rank] = self.high
            elif first <= rank < last and values:
                self.found[rank] = values[rank - first]
        self.ranks = left = [r for r in self.ranks if r not in self.found]
        if left and first <= left[0] and left[-1] < last:
            before = self.low, self.high
            self.low, self.high, self.inside = around(points, inside, left[0] - first, left[-1] - first, *before)
            # So few values that no two points of a sketch part them: bring them.
            self.inside = 0 if (self.low, self.high) == before else self.inside
        elif left:
            # A sketch that was worse than it says: take the whole column again.
            self.low, self.high, self.inside = -math.inf, math.inf, self.total


def around(points: Points, n: int, first: int, last: int, low: float, high: float) -> tuple[float, float, int]:
    """Values surely at or below rank ``first`` and at or above ``last`` of ``n``, and how many may lie strictly between.

    ``points``: (fraction, value) of a sketch of the ``n`` values; ``low`` and ``high`` hold where no point does.
    """
    slack = 2 * ERROR * n + 2
    under = max(((f * n, v) for f, v in points if f * n + slack <= first), default=(0, low))
    over = min(((f * n, v) for f, v in points if f * n - slack >= last), default=(n, high))
    return under[1], over[1], 0 if under[1] == over[1] else math.ceil(over[0] - under[0] + 2 * slack)


def fractions(qs: Sequence[float]) -> list[float]:
    """Where a sketch is asked so that its points bracket the fractions closely."""
    return sorted({min(1.0, max(0.0, q + side * 3.5 * ERROR)) for q in qs for side in (-1, 1)})


EVEN = [i / POINTS for i in range(POINTS + 1)]


def sketch(value: Column, at: Sequence[float]) -> Column:
    """Points of a column's distribution from a mergeable sketch, as an array of (f, v)."""
    found = F.percentile_approx(value, list(at), int(1 / ERROR))
    return F.zip_with(F.array(*map(F.lit, at)), found, lambda f, v: F.struct(f.alias("f"), v.alias("v")))


def finite(column: str) -> Column:
    """The column as double, NULL where it is NaN, infinite or missing."""
    v = F.col(column).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def ranks_of(n: int, q: float) -> tuple[int, int, float]:
    """The two neighbouring ranks of a fraction, and how far the quantile lies between them."""
    at = (n - 1) * q
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def between(low: float, high: float, part: float) -> float:
    """Linear interpolation; the second form is for neighbours whose distance is beyond a double."""
    if part == 0 or low == high:
        return low
    step = high - low
    return low + step * part if math.isfinite(step) else low * (1 - part) + high * part


def bracketed_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float], sizes: dict[tuple, tuple[int, Points]],
                        group: str | None = None, inside: int = INSIDE) -> dict[tuple, float]:
    """{(group, column, q): value} from the second scan on.

    ``sizes``: for each (group, column) the number of finite values and their sketch at :func:`fractions`, from a scan the
    caller makes. A column without finite values has no entry.
    """
    wanted: dict[tuple, Bracket] = {}
    for (g, c), (n, points) in sizes.items():
        for q in qs if n else ():
            low, high, _ = ranks_of(n, q)
            wanted[g, c, q] = Bracket(g, c, sorted({low, high}), *around(points or [], n, low, high, -math.inf, math.inf), n)
    todo = list(wanted.values())
    while todo:
        _scan(df, todo, group, inside)
        todo = [b for b in todo if b.ranks]
    out = {}
    for (g, c, q), bracket in wanted.items():
        low, high, part = ranks_of(sizes[g, c][0], q)
        out[g, c, q] = between(bracket.found[low], bracket.found[high], part)
    return out


def _scan(df: DataFrame, brackets: list[Bracket], group: str | None, most: int) -> None:
    """One pass over the columns that still have open brackets."""
    names = list(dict.fromkeys(b.column for b in brackets))
    # The k-th brackets of a column in all groups share a slot, so the number of aggregates does not grow with the groups.
    own: dict[tuple, list[Bracket]] = {}
    for b in brackets:
        own.setdefault((b.group, b.column), []).append(b)
    slots: dict[tuple[int, int], list[Bracket]] = {}
    for (_, c), found in own.items():
        for k, b in enumerate(found):
            slots.setdefault((names.index(c), k), []).append(b)
    rows = df.select(*([F.col(group).alias("_g")] if group else []), *[finite(c).alias(f"_v{i}") for i, c in enumerate(names)])
    if group:
        cells = [(g, [[(b.low, b.high) for b in own.get((g, c), [])] for c in names]) for g in {b.group for b in brackets}]
        kind = df.schema[group].dataType.simpleString()
        # One row for each group, all of which the caller holds already.
        rows = rows.join(F.broadcast(df.sparkSession.createDataFrame(cells, f"_g {kind}, _e array<array<struct<low:double,high:double>>>")), "_g")
    makes, brought = [F.lit(0).alias("_uno")], {}
    for (i, k), shared in slots.items():
        v, at = F.col(f"_v{i}"), F.get(F.get("_e", F.lit(i)), F.lit(k)) if group else None
        low, high = (at["low"], at["high"]) if group else (F.lit(shared[0].low), F.lit(shared[0].high))
        own_name = f"{i}_{k}"
        makes += [F.count_if(v < low).alias("_a" + own_name), F.count_if(v == low).alias("_b" + own_name)]
        if any(b.low != b.high for b in shared):
            within = F.when((v > low) & (v < high), v)
            brought[i, k] = max(b.inside for b in shared) <= most
            gathered = F.collect_list(within) if brought[i, k] else F.struct(F.count(within).alias("n"), sketch(within, EVEN).alias("p"))
            makes += [F.count_if(v == high).alias("_c" + own_name), gathered.alias("_x" + own_name)]
    for r in (rows.groupBy("_g").agg(*makes) if group else rows.agg(*makes)).collect():
        for i, k in slots:
            mine = own.get((r["_g"] if group else None, names[i]), [])
            if k >= len(mine):
                continue
            below, at_low = r[f"_a{i}_{k}"], r[f"_b{i}_{k}"]
            if (i, k) not in brought or mine[k].low == mine[k].high:
                mine[k].narrow(below, at_low, 0, 0, [], [])
            elif brought[i, k]:
                values = sorted(r[f"_x{i}_{k}"])
                mine[k].narrow(below, at_low, len(values), r[f"_c{i}_{k}"], values, [])
            else:
                x = r[f"_x{i}_{k}"]
                mine[k].narrow(below, at_low, x["n"], r[f"_c{i}_{k}"], [], x["p"] or [])
