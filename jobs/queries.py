"""The jobs as registered queries over the driver's tables: each runs its job twice into a new folder and returns the whole
output as it stands then. Their SQL computes the same from the tables at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import oracles
from tessera.plans.registry import SALT
from tessera.sources.session import new_folder

from . import index_documents, seal_days


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")
    # the table may be a file or a folder; a pattern stands for either
    for _ in range(2):
        out = index_documents.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/chunks", f"{folder}/checkpoint", {"salt": SALT})
    personal = F.aggregate(F.map_values("personal"), F.lit(0).cast("long"), lambda n, x: n + x)
    return out.select("doc_id", "lang", "source", "idx", "chunk_id", "text", "start", F.col("end").alias("stop"), personal.alias("n_personal"), "seal")


def job2_seal_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    for through in ("2024-01-12", None):
        out = seal_days.run(spark, f"{sf_dir}/events.parquet", folder, through)
    return out.select(F.col("day").cast("string").alias("day"), "log_id", "seq", "event", "request_id", "details", "prev_hash", "record_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_index_documents, job2_seal_days)}


def _job1() -> str:
    return f"""{oracles.redacted_documents()}, {oracles.fixed_chunks("(SELECT doc_id, redacted AS text FROM redacted)")},
many AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id),
seals AS (SELECT d.doc_id, sha256('{SALT}:' || coalesce(e.body, '')) AS seal FROM documents d LEFT JOIN (SELECT doc_id, string_agg(placeholder || '=' || original, '|' ORDER BY placeholder) AS body FROM entries GROUP BY doc_id) e USING (doc_id))
SELECT doc_id, d.lang, d.source, idx, chunk_id, o.text, start, stop, coalesce(n, 0) AS n_personal, seal
FROM ordered o JOIN documents d USING (doc_id) JOIN seals USING (doc_id) LEFT JOIN many USING (doc_id)"""


def _job2() -> str:
    return """WITH RECURSIVE records AS (
  SELECT user_id::VARCHAR AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS event, event_id::VARCHAR AS request_id, strftime(ts, '%Y-%m-%d') AS day,
    '{"props":' || replace(props, ' ', '') || ',"value":' || value || '}' AS details, printf('%d.%06d', epoch_us(ts) // 1000000, epoch_us(ts) % 1000000) AS secs FROM events),
bodies AS (SELECT *, '{"actor":"service","details":' || details || ',"event":"' || event || '","prev_hash":"' AS head,
  '","record_id":"' || substr(sha256(log_id || ':' || seq || ':' || request_id), 1, 12) || '","request_id":"' || request_id || '","ts":' || regexp_replace(regexp_replace(secs, '(\\.\\d*?)0+$', '\\1'), '\\.$', '.0') || '}' AS tail FROM records),
sealed AS (
  SELECT log_id, seq, 'GENESIS' AS prev_hash, sha256(head || 'GENESIS' || tail) AS record_hash FROM bodies WHERE seq = 1
  UNION ALL SELECT b.log_id, b.seq, s.record_hash, sha256(b.head || s.record_hash || b.tail) FROM sealed s JOIN bodies b ON b.log_id = s.log_id AND b.seq = s.seq + 1)
SELECT day, log_id, seq, event, request_id, details, prev_hash, record_hash FROM sealed JOIN records USING (log_id, seq)"""


def oracle_sql() -> dict[str, str]:
    return {"job1_index_documents": _job1(), "job2_seal_days": _job2()}
