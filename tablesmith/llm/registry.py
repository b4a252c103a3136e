"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from . import decontamination, edit_embedding, html_extraction, mixing, quality, sharding, simhash, token_counts, token_files, toxicity

MODULES = [mixing, token_counts, html_extraction, quality, token_files, toxicity, sharding, simhash, decontamination, edit_embedding]


def queries() -> dict:
    import corpus_pipeline

    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()} | own
