"""The queries of the engine by name, and their SQL."""

from __future__ import annotations

from pairforge.plans import keywords, metrics, texts

MODULES = (metrics, texts, keywords)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
