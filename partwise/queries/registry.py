"""Collects the queries of the core."""

from __future__ import annotations

from partwise.queries import concentration, curation, evaluation, release, streams, structure

MODULES = (concentration, curation, evaluation, structure, release, streams)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
