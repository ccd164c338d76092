"""Keeps a store of redacted chunks, as retrieval reads them, up to date with a folder of documents.

    python -m jobs.index_documents --source DOCUMENTS --output STORE --checkpoint CHECKPOINT [--config jobs/index_documents.json]

A file stream that ends when all new files are done: its checkpoint knows the files that were taken, so that each run takes
the new ones alone, and a run that broke off goes on where it was. Personal data is replaced by placeholders before texts are
cut, so that no chunk holds any; each chunk carries how much its document had, by type, and the seal of the placeholders' map.
Rows need nothing of each other: no shuffle, whatever source or document is large.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.privacy import pii_spans, placeholders, redact, redaction_entries, seal, type_counts
from tessera.operators.chunking import chunk_documents

from .common import command_line, with_defaults

log = logging.getLogger("index_documents")

DEFAULTS = {
    "schema": "doc_id bigint, text string, lang string, source string",
    "id": "doc_id",
    "text": "text",
    "partition": "lang",
    "carry": ["source"],
    "types": ["SSN", "PHONE", "EMAIL", "MRN", "DATE", "PERSON", "ZIP", "CREDIT_CARD"],
    "thresholds": {"PERSON": 0.7},
    "salt": "",
    "strategy": "fixed",
    "options": {"size": 800, "overlap": 120},
    "bytes_per_batch": 16 << 30,
}


def redacted_chunks(docs: DataFrame, settings: dict) -> DataFrame:
    """Chunks of documents (doc_id, text, the partition's column and what is carried) without personal data. A null text has
    none."""
    spans, names = pii_spans(F.col("text"), settings["types"], settings["thresholds"]), placeholders(F.col("_spans"))
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_spans", spans).withColumn("_names", names)
    rows = rows.withColumn("personal", type_counts(F.col("_spans"))).withColumn("seal", seal(redaction_entries(F.col("_spans"), F.col("_names")), F.lit(settings["salt"])))
    rows = rows.withColumn("text", redact(F.col("text"), F.col("_spans"), F.col("_names"))).drop("_spans", "_names")
    kept = (*settings["carry"], "personal", "seal", settings["partition"])
    return chunk_documents(rows, settings["strategy"], keep=kept, **settings["options"])


def stored(spark: SparkSession, output: str, source: DataFrame, settings: dict) -> DataFrame:
    """The store as it stands."""
    return spark.read.schema(redacted_chunks(source, settings).schema).parquet(output)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes the files of `source` (a folder or a pattern of Parquet files) that are new to the checkpoint, and adds their
    chunks to `output`, in folders by the partition's column. Returns the whole store."""
    settings = with_defaults(config, DEFAULTS)
    names = [settings["partition"], *settings["carry"]]
    shaped = lambda rows: rows.select(F.col(settings["id"]).alias("doc_id"), F.col(settings["text"]).alias("text"), *names)
    arriving = shaped(spark.readStream.schema(settings["schema"]).option("maxBytesPerTrigger", settings["bytes_per_batch"]).parquet(source))
    read = arriving.observe("documents", F.count("*").alias("rows"))
    chunks = redacted_chunks(read, settings).observe("chunks", F.count("*").alias("rows"))
    stream = chunks.writeStream.format("parquet").partitionBy(settings["partition"]).option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    for batch in stream.recentProgress:
        rows = {name: metrics["rows"] for name, metrics in batch.observedMetrics.items()}
        log.info("batch %d: read %d documents of %s, wrote %d chunks to %s", batch.batchId, rows.get("documents", 0), source, rows.get("chunks", 0), output)
    if not stream.recentProgress or not any(batch.numInputRows for batch in stream.recentProgress):
        log.info("nothing new in %s", source)
    empty = shaped(spark.createDataFrame([], settings["schema"]))
    return stored(spark, output, empty, settings)


if __name__ == "__main__":
    command_line("index_documents", run, {"source": "folder or pattern of Parquet files", "output": "folder of the store", "checkpoint": "folder of the stream's checkpoint"})
