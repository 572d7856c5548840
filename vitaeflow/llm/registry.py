"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from vitaeflow.llm import collocations, decontamination, divergence, embedding_links, html_text, language, mixing, near_duplicates, quality, sharding, token_counts, toxicity, warc

MODULES = (mixing, warc, token_counts, toxicity, html_text, near_duplicates, quality, sharding, language, decontamination, embedding_links, collocations, divergence)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
