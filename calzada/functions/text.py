"""Text normalisation as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank around a cell: Spark's trim() alone only drops spaces.
BLANKS = " \t\n\r\x0b\x0c\u00a0"

NULL_TEXT = ("null", "pandas", "empty")


def strip(c: Column) -> Column:
    """Text without surrounding blanks; NULL stays NULL."""
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def clean_cell(c: Column) -> Column:
    """Stripped text with NULL as the empty string."""
    return F.coalesce(strip(c), F.lit(""))


# Put in front of a letter to make initcap() start a word there; not a character of any cell.
_BREAK = "\u0001 "


def title_case(c: Column) -> Column:
    """Upper-case the first letter after every non-letter.

    ``initcap`` only restarts after a blank, so ``80-regional`` and ``10a`` would come out wrong;
    here it is shown a blank at those places. Unlike splitting into runs of letters, all of it
    stays inside code generation.
    """
    # Most cells have no such place, which is found out faster than replaced.
    shown = F.when(c.rlike(r"[^\p{L} ]\p{L}"), F.regexp_replace(c, r"([^\p{L} ])(?=\p{L})", "$1" + _BREAK)).otherwise(c)
    return F.replace(F.initcap(shown), F.lit(_BREAK), F.lit(""))


def _named_null(c: Column, null_text: str, as_text: str) -> Column:
    if null_text not in NULL_TEXT:
        raise ValueError(f"null_text must be one of {NULL_TEXT}, not {null_text!r}")
    if null_text == "null":
        return c
    return F.coalesce(c, F.lit("" if null_text == "empty" else as_text))


def normal_title(c: Column, null_text: str = "null") -> Column:
    """Stripped and title-cased; missing text is NULL, ``Nan`` or empty as asked."""
    return _named_null(title_case(strip(c)), null_text, "Nan")


def normal_upper(c: Column, null_text: str = "null") -> Column:
    return _named_null(F.upper(strip(c)), null_text, "NAN")


def normal_lower(c: Column, null_text: str = "null") -> Column:
    return _named_null(F.lower(strip(c)), null_text, "nan")


def normal_plain(c: Column, null_text: str = "null") -> Column:
    return _named_null(strip(c), null_text, "nan")


def match_key(c: Column) -> Column:
    """Join key that ignores case and surrounding blanks."""
    return F.lower(strip(c))


def folded(c: Column) -> Column:
    """Text under a collation that ignores case and accents, for equality and joins."""
    return F.collate(c, "UNICODE_CI_AI")
