"""Derived traffic measures and the predicates and orders the queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label and first/last hour of each day period.
DAY_PERIODS = (("Madrugada", 0, 5), ("Mañana", 6, 11), ("Tarde", 12, 17), ("Noche", 18, 23))
SEVERITIES = ("Crítico", "Moderado", "Leve")
RUSH_HOURS = ((6, 9), (17, 20))
# Texts that stand for a missing corridor name.
UNNAMED = ("", "Nan", "None")


def day_period(hour: Column) -> Column:
    """Name of the day period; NULL outside 0-23."""
    out = None
    for name, first, last in DAY_PERIODS:
        hit = hour.between(first, last)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def open_day_period(hour: Column) -> Column:
    """As :func:`day_period`, with everything that is not before 18h counted as night."""
    return F.coalesce(day_period(hour), F.lit(DAY_PERIODS[-1][0]))


def rush_hour(hour: Column) -> Column:
    (a, b), (c, d) = RUSH_HOURS
    return hour.between(a, b) | hour.between(c, d)


def field_order(c: Column, values: Sequence[str]) -> Column:
    """1-based position in ``values``; 0 (sorts first) for anything else."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), c), F.lit(0)).cast("int")


def named(corridor: Column) -> Column:
    """True where the corridor has a real name."""
    return corridor.isNotNull() & ~corridor.isin(*UNNAMED)


def slower_than(speed: Column, kmh: float) -> Column:
    """Number of readings under the threshold; a missing speed is not under it."""
    return F.count_if(speed < kmh)
