"""The question-answering plan: triage, retrieve, synthesise, verify, respond, as one DataFrame program over requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import MIN_GROUNDEDNESS, PII_TYPES
from ..functions.privacy import leak_count, pii_spans, placeholders, redact, redaction_entries, seal
from ..functions.text import half_even, word_count
from ..operators.answer import assemble_context, final_answer, intent, prompt_for, respond_to_prompt, token_cost
from ..operators.guardrails import InputPolicy, check_answer, check_request
from ..operators.index import LexicalIndex
from ..operators.postings import PostingIndex
from ..operators.retrieve import hybrid


@dataclass(frozen=True)
class AskOptions:
    policy: InputPolicy = field(default_factory=InputPolicy)
    top_k: int = 5
    prefetch: int = 20
    max_context: int = 4000
    min_groundedness: float = MIN_GROUNDEDNESS
    pii_types: tuple[str, ...] = PII_TYPES
    salt: str = ""
    #: Parts that may be replaced: the answer as a column of the prompt, vectors of a list of texts, and the reranker's score
    #: as a column of query and text.
    answer: Callable[[Column], Column] = respond_to_prompt
    embed: Callable | None = None
    score: Callable[[Column, Column], Column] | None = None


_ENTRIES = "array<struct<placeholder:string,original:string>>"


def triage(requests: DataFrame, options: AskOptions) -> DataFrame:
    """Requests (qid, query) with verdict, intent, redacted query, its map and its seal."""
    rows = requests.withColumn("verdict", check_request(F.col("query"), options.policy)).withColumn("blocked", ~F.col("verdict.allowed"))
    rows = rows.withColumn("block_reason", F.when(F.col("blocked"), F.col("verdict.reason")).otherwise(F.lit("")))
    rows = rows.withColumn("intent", F.when(F.col("blocked"), F.lit("rejected")).otherwise(intent(F.coalesce("query", F.lit("")))))
    rows = rows.withColumn("_spans", pii_spans(F.coalesce("query", F.lit("")), options.pii_types)).withColumn("_names", placeholders(F.col("_spans")))
    live = ~F.col("blocked")
    entries = redaction_entries(F.col("_spans"), F.col("_names"))
    rows = rows.withColumn("redacted_query", F.when(live, redact(F.coalesce("query", F.lit("")), F.col("_spans"), F.col("_names"))).otherwise(F.lit("")))
    rows = rows.withColumn("query_entries", F.when(live, entries).otherwise(F.expr(f"cast(array() as {_ENTRIES})")))
    return rows.withColumn("redaction_seal", F.when(live, seal(entries, F.lit(options.salt))).otherwise(F.lit(""))).drop("_spans", "_names")


def _last_of_each(lists: str) -> Column:
    """The map of several hits: of each placeholder, the original in the last of them that has it."""
    behind = lambda i: F.flatten(F.slice(lists, i + 2, F.size(lists)))
    last = F.transform(lists, lambda es, i: F.filter(es, lambda e: ~F.exists(behind(i), lambda x: x["placeholder"] == e["placeholder"])))
    return F.array_sort(F.flatten(last))


def ask(requests: DataFrame, chunks: DataFrame, index: LexicalIndex | PostingIndex | None = None, decisions: DataFrame | None = None, options: AskOptions | None = None) -> DataFrame:
    """One row for each request (qid, query). decisions: (qid, decision) of reviewers.

    Each request's redaction map is its own: that of its query and those of its hits, later originals replacing earlier
    ones of the same placeholder. Blocked requests skip all stages behind triage.
    """
    options = options or AskOptions()
    spans = lambda c: pii_spans(c, options.pii_types)
    triaged = triage(requests, options)
    live = triaged.where(~F.col("blocked")).select("qid", F.when(F.col("redacted_query") != "", F.col("redacted_query")).otherwise(F.col("query")).alias("query"))
    hits = hybrid(live, chunks, index, options.top_k, options.prefetch, **({"embed": options.embed} if options.embed else {}), score=options.score)
    hits = hits.withColumn("_s", spans(F.col("text"))).withColumn("_n", placeholders(F.col("_s")))
    hits = hits.withColumn("entries", redaction_entries(F.col("_s"), F.col("_n"))).withColumn("text", redact(F.col("text"), F.col("_s"), F.col("_n"))).drop("_s", "_n")
    # hits are read once: their texts and maps are listed together
    context = assemble_context(hits, options.max_context, ("entries",))
    rows = triaged.join(context.withColumn("hit_entries", _last_of_each("entries")).drop("entries"), "qid", "left")
    rows = rows.withColumn("context_text", F.coalesce("context_text", F.lit(""))).withColumn("citations", F.coalesce("citations", F.expr("cast(array() as array<string>)")))
    rows = rows.withColumn("hit_entries", F.coalesce("hit_entries", F.expr(f"cast(array() as {_ENTRIES})")))
    kept = F.filter("query_entries", lambda e: ~F.exists("hit_entries", lambda h: h["placeholder"] == e["placeholder"]))
    rows = rows.withColumn("entries", F.concat(kept, F.col("hit_entries")))

    free = ~F.col("blocked")
    rows = rows.withColumn("_prompt", prompt_for(F.col("intent"), F.col("redacted_query"), F.col("context_text")))
    rows = rows.withColumn("draft_answer", F.when(free, options.answer(F.col("_prompt"))).otherwise(F.lit("")))
    rows = rows.withColumn("tokens_in", F.when(free, word_count(F.col("_prompt"))).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("tokens_out", word_count(F.col("draft_answer")).cast("long"))
    checked = check_answer(F.col("draft_answer"), F.col("context_text"), leak_count(F.col("draft_answer"), F.col("entries")), options.min_groundedness)
    rows = rows.withColumn("_check", checked)
    rows = rows.withColumn("groundedness", F.when(free, F.col("_check.groundedness")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("needs_hitl", free & ~F.col("_check.allowed")).withColumn("hitl_reason", F.when(F.col("needs_hitl"), F.col("_check.reason")).otherwise(F.lit("")))
    if decisions is None:
        rows = rows.withColumn("decision", F.lit(None).cast("string"))
    else:
        rows = rows.join(decisions.select("qid", "decision"), "qid", "left")
    rows = rows.withColumn("hitl_decision", F.when(F.col("needs_hitl"), F.coalesce("decision", F.lit("reject"))))
    rows = rows.withColumn("final_answer", F.when(free, final_answer(F.col("draft_answer"), F.col("needs_hitl"), F.col("hitl_reason"), F.col("decision"))).otherwise(F.lit("")))
    rows = rows.withColumn("cost_usd", half_even(token_cost(F.col("tokens_in"), F.col("tokens_out")), 9))
    names = "qid intent blocked block_reason redacted_query redaction_seal context_text citations draft_answer groundedness needs_hitl hitl_reason hitl_decision final_answer tokens_in tokens_out cost_usd"
    return rows.select(*names.split())


def qa_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn and the turn behind it, where that is the assistant's."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("answer"))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "question", "answer")
