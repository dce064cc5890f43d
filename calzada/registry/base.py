"""A registered query: what to run and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from calzada.registry.fixture import Fixture
from calzada.registry.oracle import with_tables


@dataclass(frozen=True)
class Entry:
    run: Callable[[Fixture], DataFrame]
    sql: str | None = None

    @property
    def oracle(self) -> str | None:
        return None if self.sql is None else with_tables(self.sql)
