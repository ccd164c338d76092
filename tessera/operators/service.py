"""What surrounds answering requests: keys, rate limits, metrics, and event streams of answers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.constants import DEFAULT_KEY, RATE_PER_MINUTE
from ..functions.arrays import exploded
from ..functions.text import fixed_digits
from ..sources.session import ship
from .audit import json_text

WINDOW_S = 60.0


def authorise(requests: DataFrame, keys: DataFrame, key: str = "api_key") -> DataFrame:
    """Requests and authorised: whether the key is not empty and among keys (api_key)."""
    known = keys.select(F.col("api_key").alias("_known")).distinct()
    joined = requests.join(known, requests[key] == F.col("_known"), "left")
    return joined.withColumn("authorised", F.col("_known").isNotNull() & (F.coalesce(F.col(key), F.lit("")) != "")).drop("_known")


def rate_limit(requests: DataFrame, per_minute: int = RATE_PER_MINUTE, key: str = "user_id", at: str = "at", order: str = "event_id") -> DataFrame:
    """(key, order, at, allowed): a request is denied where per_minute allowed ones of its key are less than 60 s old; a
    denied one doesn't count, and neither does one without a time.

    A key's requests behind a minute without any don't depend on those before. So requests are counted by key and minute of
    the clock; behind a minute that has none, a new piece of the key begins, and pieces are dealt to tasks on their own.
    Within a piece, requests are sorted by time and judged as they stream by, with no more kept than the times of its last
    per_minute allowed ones; the work is linear. Only requests of a piece follow one another.
    """
    ship(requests.sparkSession)
    asked = requests.select(key, order, F.col(at).cast("double").alias(at)).withColumn("_minute", F.floor(F.col(at) / WINDOW_S))
    minutes = asked.groupBy(key, "_minute").agg(F.lit(True).alias("_some")).drop("_some")
    by_minute = Window.partitionBy(key).orderBy("_minute")
    begins = F.col("_minute") - F.lag("_minute").over(by_minute) > 1
    pieces = minutes.withColumn("_begins", F.when(begins | F.lag("_minute").over(by_minute).isNull(), F.col("_minute")))
    # the minute in which the piece began that a minute belongs to
    pieces = pieces.withColumn("_piece", F.last("_begins", True).over(by_minute)).select(F.col(key).alias("_k"), F.col("_minute").alias("_m"), "_piece")
    asked = asked.join(pieces, F.col(key).eqNullSafe(F.col("_k")) & F.col("_minute").eqNullSafe(F.col("_m")), "left")
    rows = asked.repartition(key, "_piece").sortWithinPartitions(key, "_piece", at, order).select(key, order, at, "_piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, recent = None, False, deque(maxlen=max(1, per_minute))
        for batch in batches:
            allowed = []
            for *k, t in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or k != now:
                    now, begun = k, True
                    recent.clear()
                ok = per_minute > 0 and (len(recent) < per_minute or t is None or t - recent[0] >= WINDOW_S)
                allowed.append(ok)
                if ok and t is not None:
                    recent.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(allowed, pa.bool_())], [*batch.schema.names[:3], "allowed"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:3], StructField("allowed", BooleanType())]))


def service_metrics(requests: DataFrame) -> DataFrame:
    """One row over requests (latency_ms, blocked, needs_hitl, tokens_in, tokens_out)."""
    return requests.agg(
        F.count("*").alias("requests_total"),
        F.count_if("blocked").alias("requests_blocked"),
        F.count_if("needs_hitl").alias("hitl_escalations"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("latency_avg_ms"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in_total"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out_total"),
    )


#: Fixed names, texts and kinds of the exposed metrics.
EXPOSED = (
    ("clinical_requests_total", "Total Q&A requests", "counter", "requests_total"),
    ("clinical_requests_blocked", "Blocked by guardrails", "counter", "requests_blocked"),
    ("clinical_hitl_escalations", "HITL escalations", "counter", "hitl_escalations"),
    ("clinical_latency_avg_ms", "Average end-to-end latency", "gauge", "latency_avg_ms"),
    ("clinical_tokens_in_total", "Total input tokens", "counter", "tokens_in_total"),
    ("clinical_tokens_out_total", "Total output tokens", "counter", "tokens_out_total"),
)


def prometheus_text(metrics: DataFrame) -> DataFrame:
    """One row, text: metrics in the exposition format."""
    lines: list[Column] = []
    for name, what, kind, column in EXPOSED:
        value = fixed_digits(F.col(column), 1) if kind == "gauge" else F.col(column).cast("string")
        lines += [F.lit(f"# HELP {name} {what}"), F.lit(f"# TYPE {name} {kind}"), F.concat(F.lit(f"{name} "), value)]
    return metrics.select(F.concat(F.array_join(F.array(*lines), "\n"), F.lit("\n")).alias("text"))


def sse_events(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, seq, frame): the frames of each answer's event stream. A delta for each part between full stops with blanks, then
    done, each with the request's id; JSON of ASCII alone behind `data: `, and an empty line. A null answer is empty."""
    of = F.concat(F.lit('data: {"request_id": '), json_text(F.col(key).cast("string")))
    parts = F.split(F.coalesce(answer, F.lit("")), r"\. ", -1)
    frames = F.concat(F.transform(parts, lambda p: F.concat(of, F.lit(', "delta": '), json_text(p), F.lit("}\n\n"))), F.array(F.concat(of, F.lit(', "done": true}\n\n'))))
    return exploded(answers, [key], frames, "frame", "seq")


def key_frame(spark, keys: Iterable[str]) -> DataFrame:
    """Keys as a table; the default one where there are none."""
    return spark.createDataFrame([(k,) for k in sorted(set(keys) or {DEFAULT_KEY})], "api_key string")


def health(spark, version: str = "1") -> DataFrame:
    """One row: status, version. A session that answers is alive."""
    return spark.createDataFrame([("ok", version)], "status string, version string")


def readiness(chunks: DataFrame) -> DataFrame:
    """One row: ready, chunks, documents; ready once anything is indexed."""
    counts = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))
    return counts.select((F.col("chunks") > 0).alias("ready"), "chunks", "documents")
