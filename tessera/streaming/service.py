"""Structured Streaming forms: rate limit, audit sealing, request metrics, answer events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.constants import RATE_PER_MINUTE
from ..operators.service import WINDOW_S
from ..sources.session import ship


def rate_limit_stream(requests: DataFrame, per_minute: int = RATE_PER_MINUTE, timeout_s: int = 120) -> DataFrame:
    """(user_id, event_id, at, allowed) of a stream of requests (user_id, event_id, at in seconds).

    State is the times of a key's allowed requests of the last minute, per_minute at most; it goes when a key is silent.
    Within a trigger a key's requests are taken in order of time; requests late by whole triggers are judged as they come.
    """
    ship(requests.sparkSession)
    key_type = requests.schema["user_id"].dataType.simpleString()
    order_type = requests.schema["event_id"].dataType.simpleString()

    def limit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["at", "event_id"], kind="stable")
        allowed = []
        for t in frame["at"].tolist():
            recent = [x for x in recent if t - x < WINDOW_S]
            ok = len(recent) < per_minute
            allowed.append(ok)
            if ok:
                recent.append(t)
        state.update((recent,))
        state.setTimeoutDuration(timeout_s * 1000)
        yield pd.DataFrame({"user_id": key[0], "event_id": frame["event_id"], "at": frame["at"], "allowed": allowed})

    return requests.groupBy("user_id").applyInPandasWithState(limit, f"user_id {key_type}, event_id {order_type}, at double, allowed boolean", "recent array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def seal_stream(records: DataFrame) -> DataFrame:
    """(log_id, seq, prev_hash, record_hash) of a stream of records (log_id, seq, head, tail), the canonical JSON before and
    behind the previous hash.

    State is a chain's last hash. A chain's records must come in order of seq over triggers; within one they are sorted.
    """
    import hashlib

    from ..operators.audit import GENESIS

    ship(records.sparkSession)

    def seal(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev = state.get[0] if state.exists else GENESIS
        frame = pd.concat(list(frames)).sort_values("seq", kind="stable")
        before, after = [], []
        for head, tail in zip(frame["head"].tolist(), frame["tail"].tolist(), strict=True):
            before.append(prev)
            prev = hashlib.sha256(f"{head}{prev}{tail}".encode()).hexdigest()
            after.append(prev)
        state.update((prev,))
        yield pd.DataFrame({"log_id": key[0], "seq": frame["seq"], "prev_hash": before, "record_hash": after})

    return records.groupBy("log_id").applyInPandasWithState(seal, "log_id string, seq long, prev_hash string, record_hash string", "last string", "append", GroupStateTimeout.NoTimeout)


def metrics_stream(requests: DataFrame, at: str = "ts", every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Request metrics for windows of event time, by a watermark for late requests."""
    sums = [
        F.count("*").alias("requests_total"),
        F.count_if("blocked").alias("requests_blocked"),
        F.count_if("needs_hitl").alias("hitl_escalations"),
        F.avg("latency_ms").alias("latency_avg_ms"),
        F.sum("tokens_in").alias("tokens_in_total"),
        F.sum("tokens_out").alias("tokens_out_total"),
    ]
    return requests.withWatermark(at, late).groupBy(F.window(at, every)).agg(*sums)


def append_stream(records: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends a stream of sealed records to a log, each batch once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")  # a repeated batch replaces itself

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
