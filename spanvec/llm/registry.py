"""The queries and SQL of this subpackage."""

from __future__ import annotations

from . import decontaminate, licenses, ngram_join, packing, quality_labels, quality_rules, suffix_dedup, token_files, toxicity, warc

MODULES = (decontaminate, quality_labels, licenses, toxicity, suffix_dedup, quality_rules, warc, token_files, ngram_join, packing)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
