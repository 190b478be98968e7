"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from cadenza.llm import chat, classifier, codes, decontaminate, lexical, neardup, packing, repair, rules, secrets, sharding, substrings, warc

MODULES = (warc, secrets, decontaminate, repair, rules, sharding, classifier, neardup, substrings, packing, codes, lexical, chat)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
