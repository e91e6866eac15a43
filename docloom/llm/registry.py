"""The queries and SQL of this subpackage."""

from __future__ import annotations

from docloom.llm import bpe, chat, classifier, decontaminate, jaccard, pii, quality_rules, sharding, substring, urlfilter

MODULES = (quality_rules, pii, sharding, chat, bpe, urlfilter, jaccard, classifier, substring, decontaminate)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in MODULES for k, f in m.ORACLES.items()}
