"""Registry of the engine's queries and their oracle SQL."""

from __future__ import annotations

from corpusgraph.queries.registry import ORACLES, QUERIES
from corpusgraph.queries import aggregates, derived, graphs, retrieval, scans  # noqa: F401  they register themselves


def flagship(spark, sf_dir):
    return QUERIES["search_hybrid"](spark, sf_dir)
