"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, conversations, decontamination, embeddings, language, licenses, lm_score, packing, secrets, sharding, simhash, substrings, token_counts

MODULES = (sharding, packing, language, secrets, simhash, decontamination, embeddings, licenses, lm_score, token_counts, centroids, conversations, substrings)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
