"""The corpus pipeline: documents through operators of tablesmith.llm, stage by stage."""

from __future__ import annotations

from tablesmith.llm import decontamination, mixing, quality, simhash, token_files
from tablesmith.llm.common import stored, table

STAGES = [
    ("quality classifier", quality.stage),
    ("SimHash near-dedup", simhash.stage),
    ("benchmark decontamination", decontamination.stage),
    ("mixing to target weights", mixing.stage),
    ("token-ID output", token_files.stage),
]

#: SQL can't express a trained model, similarity search or encoding; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages over documents; what each returns is written, and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
