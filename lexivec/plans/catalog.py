"""All queries of the core, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from lexivec.plans import acquisition, benchmarks, capabilities, integrity, searches, texts

_PLANS = (searches, texts, acquisition, benchmarks, capabilities, integrity)
QUERIES: dict = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
SQL: dict[str, str] = {k: v for p in _PLANS for k, v in p.SQL.items()}
