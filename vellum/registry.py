"""Every query of the library next to its DuckDB statement."""

from __future__ import annotations

from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
