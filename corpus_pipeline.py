"""The corpus pipeline: quality, near-duplicates, decontamination, PII, mixing. Every stage works on all that the one before kept.

Defined results: an empty table passes through all stages; null texts are empty texts to quality and linked with nothing; rows that
share an id, or have none, are judged each by its own text; extra columns come along. The result is the mix itself: the
documents' columns, text being the words that the mix takes of a document (repeats included).
"""

from __future__ import annotations

from gridscribe.llm import common as C
from gridscribe.llm import decontam, minhash, mixing, pii, quality

#: (name, function of (spark, docs, sf_dir)). Each result is written as Parquet and read again as the next one's docs.
STAGES = [
    ("quality", quality.quality_stage),
    ("near_dedup", minhash.dedup_stage),
    ("decontamination", decontam.decontam_stage),
    ("pii", pii.pii_stage),
    ("mixing", mixing.mixing_stage),
]

#: The field and the surrogates can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with C.scratch(spark):  # what a stage wrote on its way goes when its result is there
            docs = C.stage(step(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
