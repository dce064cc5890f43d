"""Joins against summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from calzada.sources.workspace import materialise


def join_summary(facts: DataFrame, summary: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Attach an aggregate to the rows it came from.

    The summary is written first, so Catalyst plans with its true size: a broadcast while it is
    below ``spark.sql.autoBroadcastJoinThreshold``, otherwise a shuffle join whose hot keys adaptive
    execution splits. Left to guess, it would shuffle the facts before finding out.
    """
    return facts.join(materialise(summary, "summary"), on, how)
