"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ans, balance, codes, decontaminate, html_text, packing, pitman_yor, quality_rules, simhash, suffix_dedup, toxicity, warc, whitening

_MODULES = [suffix_dedup, quality_rules, simhash, packing, ans, decontaminate, balance, warc, pitman_yor, html_text, toxicity, codes, whitening]


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
