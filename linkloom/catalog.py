"""Registered queries over the driver's tables and their SQL. Each query runs over whole tables (see adapters)."""

from __future__ import annotations

from linkloom import catalog_chains, catalog_graph, catalog_more, catalog_scalars, catalog_similarity

FLAGSHIP = "A11_weighted_jaccard"
_PARTS = (catalog_scalars, catalog_similarity, catalog_graph, catalog_chains, catalog_more)


def queries() -> dict:
    return {name: run for part in _PARTS for name, run in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for part in _PARTS for name, text in part.ORACLES.items()}
