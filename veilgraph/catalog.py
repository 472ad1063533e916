"""The registered queries of the graph engine and the SQL that gives the same rows."""

from __future__ import annotations

from veilgraph.plans.oracle import SQL
from veilgraph.plans.queries import QUERIES

__all__ = ["QUERIES", "SQL"]
