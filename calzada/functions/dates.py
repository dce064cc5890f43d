"""Dates, month names and month arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from calzada.functions.text import strip

# The month and weekday names of the data, in calendar order.
MONTHS = ("Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
          "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre")
WEEKDAYS = ("Lunes", "Martes", "Miercoles", "Jueves", "Viernes", "Sabado", "Domingo")


def month_number(name: Column) -> Column:
    """1-12 from a Spanish month name in any case; 0 if unknown or missing."""
    names = F.array(*[F.lit(m.lower()) for m in MONTHS])
    return F.coalesce(F.array_position(names, F.lower(strip(name))), F.lit(0)).cast("int")


def to_timestamp(c: Column, layouts: Sequence[str] = ()) -> Column:
    """ISO text, else the first layout (Spark's patterns) that fits; NULL if none does."""
    others = [F.try_to_timestamp(strip(c), F.lit(x)).cast("timestamp_ntz") for x in layouts]
    return F.coalesce(strip(c).try_cast("timestamp_ntz"), *others)


def to_date(c: Column, layouts: Sequence[str] = ()) -> Column:
    """As :func:`to_timestamp`, as a date."""
    others = [F.try_to_timestamp(strip(c), F.lit(x)).cast("date") for x in layouts]
    return F.coalesce(strip(c).try_cast("date"), *others)


def month_index(year: Column, month: Column, first_year: Column) -> Column:
    """Months counted from January (= 1) of the first year."""
    return ((year - first_year) * 12 + month).cast("int")


def month_end(first_year: Column, t: Column) -> Column:
    """Last day of the month with index ``t``."""
    return F.last_day(F.add_months(F.make_date(first_year, F.lit(1), F.lit(1)), t - 1))


def month_start(year: Column, month: Column) -> Column:
    """First day of the month; month 0 (unknown) is shown as January, any other outside 1-12 gives NULL."""
    return F.make_date(year, F.when(month == 0, F.lit(1)).when(month.between(1, 12), month), F.lit(1))
