"""Whole runs over tables of requests and of judged examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import RATE_PER_MINUTE
from ..functions.text import half_even
from ..operators.audit import canonical_json
from ..operators.evaluate import eval_cases
from ..operators.index import LexicalIndex
from ..operators.postings import PostingIndex
from ..operators.service import authorise, rate_limit
from .ask import AskOptions, ask


def serve(requests: DataFrame, keys: DataFrame, chunks: DataFrame, index: LexicalIndex | PostingIndex | None = None, decisions: DataFrame | None = None, options: AskOptions | None = None, per_minute: int = RATE_PER_MINUTE, since: DataFrame | None = None) -> DataFrame:
    """One row for each request (qid, api_key, at, query, and stream and latency_ms where they are known): qid, api_key, at, stream,
    query_chars, status, answer, citations, groundedness, hitl_decision, hitl_reason, redaction_seal, latency_ms, and what
    metrics count (blocked, needs_hitl, tokens_in, tokens_out).

    Status 401: no such key; 429: over the key's rate; 422: blocked by a guardrail; 200: answered. Only requests that get
    past a gate go on to the next. since: (api_key, at) of requests that were let through before these, which count in rates.
    """
    known = authorise(requests, keys)
    counted = known.where("authorised").select("qid", "api_key", F.col("at").cast("double").alias("at"))
    if since is not None:
        counted = counted.unionByName(since.select(F.lit(None).cast(counted.schema["qid"].dataType).alias("qid"), "api_key", F.col("at").cast("double").alias("at")))
    rated = rate_limit(counted, per_minute, key="api_key", at="at", order="qid").where("qid is not null").select("qid", "allowed")
    gated = known.join(rated, "qid", "left")
    admitted = gated.where("allowed").select("qid", F.trim(F.coalesce("query", F.lit(""))).alias("query"))
    answered = ask(admitted, chunks, index, decisions, options)
    given = lambda c, other: F.coalesce(c, other).alias(c) if c in requests.columns else other.alias(c)
    asked = gated.select("qid", "api_key", F.col("at").cast("double").alias("at"), given("stream", F.lit(False)), given("latency_ms", F.lit(0.0)), F.length(F.trim(F.coalesce("query", F.lit("")))).alias("query_chars"), "authorised", "allowed")
    rows = asked.join(answered, "qid", "left")
    status = F.when(~F.col("authorised"), 401).when(~F.coalesce("allowed", F.lit(False)), 429).when(F.col("blocked"), 422).otherwise(200)
    said = F.when(status == 200, F.col("final_answer")).when(status == 422, F.col("block_reason")).otherwise(F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    return rows.select(
        "qid",
        "api_key",
        "at",
        "stream",
        "query_chars",
        status.alias("status"),
        said.alias("answer"),
        F.coalesce("citations", none).alias("citations"),
        F.coalesce("groundedness", F.lit(0.0)).alias("groundedness"),
        "hitl_decision",
        F.coalesce("hitl_reason", F.lit("")).alias("hitl_reason"),
        F.coalesce("redaction_seal", F.lit("")).alias("redaction_seal"),
        half_even(F.col("latency_ms"), 1).alias("latency_ms"),
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
        F.coalesce("needs_hitl", F.lit(False)).alias("needs_hitl"),
        F.coalesce("tokens_in", F.lit(0)).cast("long").alias("tokens_in"),
        F.coalesce("tokens_out", F.lit(0)).cast("long").alias("tokens_out"),
    )


def _event(name: str, actor: Column, **details: Column) -> Column:
    text = F.to_json(F.struct(*[v.alias(k) for k, v in details.items()]), {"ignoreNullFields": "false"})
    return F.struct(F.lit(name).alias("event"), actor.alias("actor"), canonical_json(text, True).alias("details"))


def _record_id(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12).alias("record_id")


def audit_records(responses: DataFrame, log_id: str | Column, ts: str | Column) -> DataFrame:
    """Records, ready to be sealed, of responses (see serve): a query, a response, and a redaction for each request that got
    past keys and rates. log_id: one name for all, or a column that gives each request's; a log is one chain, so a log for
    each key or day can be sealed by many tasks. ts: seconds as decimal text, of all or of each request."""
    admitted = responses.where("status in (200, 422)")
    made = F.array(
        _event("query", F.concat(F.lit("api:"), F.substring("api_key", 1, 6)), query_chars=F.col("query_chars"), stream=F.col("stream")),
        _event("response", F.lit("agent"), blocked=F.col("blocked"), hitl=F.col("needs_hitl"), groundedness=F.col("groundedness"), citations=F.col("citations"), latency_ms=F.col("latency_ms")),
        _event("redaction", F.lit("privacy-pipeline"), seal=F.when(F.col("redaction_seal") == "", F.lit("none")).otherwise(F.col("redaction_seal"))),
    )
    log = F.lit(log_id) if isinstance(log_id, str) else log_id
    when = F.lit(ts) if isinstance(ts, str) else ts
    rows = admitted.select(log.alias("log_id"), "qid", when.alias("ts"), F.posexplode(made).alias("k", "e"))
    request = F.col("qid").cast("string")
    return rows.select(
        "log_id",
        (F.col("qid") * 3 + F.col("k")).cast("long").alias("seq"),
        "e.event",
        request.alias("request_id"),
        "e.actor",
        "e.details",
        "ts",
        _record_id("log_id", request, "k"),
    )


def audit_cases(cases: DataFrame, log_id: str, ts: str, order: Column) -> DataFrame:
    """Records, ready to be sealed, of judged cases (see operators.evaluate.eval_cases), in the given order (a long)."""
    event = _event("eval_case", F.lit("eval-harness"), example_id=F.col("id"), passed=F.col("passed"), groundedness=F.col("groundedness"), latency_ms=F.col("latency_ms"))
    request = F.concat(F.lit("eval-"), "id")
    rows = cases.select(F.lit(log_id).alias("log_id"), order.cast("long").alias("seq"), event.alias("e"), request.alias("request_id"))
    return rows.select("log_id", "seq", "e.event", "request_id", "e.actor", "e.details", F.lit(ts).alias("ts"), _record_id("log_id", "request_id", "seq"))


def run_examples(examples: DataFrame, chunks: DataFrame, index: LexicalIndex | PostingIndex | None = None, options: AskOptions | None = None) -> DataFrame:
    """Judged cases of examples (sources.io.read_examples): each is asked, and its draft judged against its context. Time
    is not measured for single requests of a batch, so latency_ms is 0."""
    asked = examples.withColumn("qid", F.xxhash64("id"))
    got = ask(asked.select("qid", "query"), chunks, index, None, options)
    rows = asked.join(got, "qid").withColumn("answer", F.when(F.col("draft_answer") != "", F.col("draft_answer")).otherwise(F.col("final_answer")))
    return eval_cases(rows.withColumn("latency_ms", F.lit(0.0)))
