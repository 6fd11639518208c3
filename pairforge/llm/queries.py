"""All queries of this package and their SQL."""

from __future__ import annotations

from pairforge.llm import p1_sentences, p2_frequencies, p3_personal, p4_near_duplicates, p5_chunks, p6_tokens, p7_leakage, p8_mojibake

MODULES = (p1_sentences, p2_frequencies, p3_personal, p4_near_duplicates, p5_chunks, p6_tokens, p7_leakage, p8_mojibake)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
