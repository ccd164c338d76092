"""Serving as a stream: requests are answered, logged and counted batch by batch, each batch once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.constants import RATE_PER_MINUTE
from ..operators.index import LexicalIndex
from ..operators.postings import PostingIndex
from ..operators.service import WINDOW_S, service_metrics
from ..sources.io import append_batch
from ..sources.session import without_scratch
from .ask import AskOptions
from .serve import audit_records, serve

RESPONSES = (
    "qid bigint, api_key string, at double, stream boolean, query_chars int, status int, answer string, citations array<string>, groundedness double, hitl_decision string, hitl_reason string, "
    "redaction_seal string, latency_ms double, blocked boolean, needs_hitl boolean, tokens_in bigint, tokens_out bigint, batch bigint"
)


def responses(spark: SparkSession, path: str) -> DataFrame:
    """What a stream has answered so far, with the batch of each."""
    try:
        return spark.read.schema(RESPONSES).parquet(f"{path}/responses")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESPONSES)


def serve_stream(requests: DataFrame, keys: DataFrame, chunks: DataFrame, path: str, checkpoint: str, index: LexicalIndex | PostingIndex | None = None, options: AskOptions | None = None, per_minute: int = RATE_PER_MINUTE) -> DataStreamWriter:
    """A query, to be started, over a stream of requests (qid, api_key, at, query): answers each batch as `serve` does a table.

    Under path, responses/batch=K holds a batch's responses and audit a log with a chain for each key (sources.io.append_batch).
    A batch is written to folders of its own number behind all that earlier batches wrote; if it is repeated after a failure,
    at whatever point, it replaces them by the same. Rates count the requests that earlier batches let through in the minute
    before a batch. A key's qid and at rise over the stream.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.agg(F.min("at")).first()[0]
        if first is None:
            return
        since = responses(spark, path).where((F.col("batch") < number) & (F.col("at") > first - WINDOW_S) & F.col("status").isin(200, 422))
        folder = f"{path}/responses/batch={number}"
        with without_scratch(spark):
            served = serve(batch, keys, chunks, index, None, options, per_minute, since.select("api_key", "at"))
            served.write.mode("overwrite").parquet(folder)
        # the log is of what was written
        written = spark.read.schema(served.schema).parquet(folder)
        append_batch(audit_records(written, F.col("api_key"), F.format_string("%.6f", "at")), f"{path}/audit", number)

    return requests.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")


def stream_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of what a stream has answered: requests that got past keys and rates."""
    return service_metrics(responses(spark, path).where(F.col("status").isin(200, 422)))
