"""All registered queries of the library and their SQL."""

from __future__ import annotations

from tessella.plans import checking, flowing, ingest, learning, measuring, shaping, speaking

_PARTS = (checking, ingest, flowing, learning, measuring, shaping, speaking)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
