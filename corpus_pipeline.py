"""The corpus pipeline over `documents`: toxicity, quality rules, MinHash near-dedup, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read back as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Scratch, table
from tessera.llm.stages import drop_low_quality, drop_near_duplicates, drop_toxic, pack_sequences, redact_secrets

STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Stages that SQL can't express (a fitted model, a suffix array, signatures); tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = scratch.put(stage(spark, docs, sf_dir))
        if hasattr(docs, "scratch_path"):
            scratch.drop(docs)
        docs = after
    return docs
