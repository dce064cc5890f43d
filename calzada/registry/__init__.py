"""Queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from calzada.registry.base import Entry


def entries() -> dict[str, Entry]:
    """All registered queries by name."""
    from calzada.registry import analytics, dashboard, operators

    return {**analytics.ENTRIES, **dashboard.ENTRIES, **operators.ENTRIES}
