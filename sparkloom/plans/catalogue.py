"""All queries over the fixture tables."""

from __future__ import annotations

from . import columns, curation, etymology, graphs, morphemes, reading, relational, repairs, reports, search, series, states, stores, texts

_MODULES = (relational, series, graphs, texts, search, morphemes, etymology, reading, states, curation, repairs, stores, reports, columns)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.query.queries.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.query.sql.items()}
