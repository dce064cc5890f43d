"""Coercion that never throws: bad text becomes NULL or a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calzada.functions.text import BLANKS

# Java's parser also takes '1d', '0x1p3' and 'NaN'; a cell only counts as a number if it looks like one. Others must not reach the
# cast either, which throws and catches an exception for each. Nothing in the pattern is tried twice.
_NUMBER = rf"^[{BLANKS}]*+[+-]?(?:[0-9]++[.]?[0-9]*+|[.][0-9]++)(?:[eE][+-]?[0-9]++)?+[{BLANKS}]*+\z"


def _looked_at(c: Column) -> tuple[Column, Column]:
    """Whether the cell holds a decimal number, and that number where it does."""
    cell = c.cast("string")
    # The cast drops all other blanks itself.
    return cell.rlike(_NUMBER), F.replace(cell, F.lit("\u00a0"), F.lit("")).try_cast("double")


def to_number(c: Column) -> Column:
    """Double, or NULL for anything that is not a finite decimal (``nan`` and ``1e999`` included)."""
    there, n = _looked_at(c)
    return F.when(there, F.when(F.abs(n) < float("inf"), n))


def to_int(c: Column, default: int | Column | None = 0) -> Column:
    """Whole part of the number in the cell; ``default`` where there is none."""
    there, n = _looked_at(c)
    # A number past all integers, infinite or not, has none.
    n = F.when(there, n).try_cast("int")
    if default is None:
        return n
    return F.coalesce(n, default if isinstance(default, Column) else F.lit(default))


def unit_clip(c: Column) -> Column:
    """Clip to [0, 1]. ``least``/``greatest`` skip NULL, hence the guard."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def upper_clip(c: Column, top: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(top), c))


def finite(c: Column) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def stable(c: Column, digits: int = 9) -> Column:
    """Drop the last bits of a mean of fractions.

    The order in which partitions are summed differs from run to run; without this a value on a
    rounding tie could come out either way.
    """
    return F.round(c, digits)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)
