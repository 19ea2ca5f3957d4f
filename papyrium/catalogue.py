"""The queries of the core operators and their SQL, by name."""

from __future__ import annotations

from .plans import boards, calendars, repairs, slots, stores, streams, tex, texts, topics, translations, worklists

_MODULES = (boards, topics, texts, stores, slots, calendars, worklists, repairs, tex, translations, streams)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
