"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from bidloom.llm import bpe, codes, counts, decontaminate, langid, middle, pii, quality, secrets, sharding, simhash, toxicity, warc

MODULES = (simhash, bpe, secrets, warc, decontaminate, langid, quality, toxicity, sharding, pii, codes, middle, counts)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
