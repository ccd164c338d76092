"""Contexts, prompts and extractive answers, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ANSWER_PROMPT, ANSWER_STOP, ESCALATED, EXTRACT_PROMPT, EXTRACT_WORDS, FIELD, NO_CONTEXT, NO_EVIDENCE, NO_FIELDS, NO_SUMMARY, PRICE_IN, PRICE_OUT, PROMPT_TAGS, SUMMARY_PROMPT, SUMMARY_WORDS
from ..functions.text import half_even, sentences, strip, token_set, tokens, word_count
from .guardrails import with_disclaimer

_LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def intent(query: Column) -> Column:
    """summarize, extract or qa, by what the lower-cased request contains."""
    q = F.lower(query)
    has = lambda *words: F.greatest(*[F.contains(q, F.lit(w)) for w in words])
    return F.when(has(*SUMMARY_WORDS), F.lit("summarize")).when(has(*EXTRACT_WORDS), F.lit("extract")).otherwise(F.lit("qa"))


def assemble_context(hits: DataFrame, max_chars: int = 4000, more: tuple[str, ...] = ()) -> DataFrame:
    """(qid, context_text, citations): tagged texts in rank order up to the first that would exceed max_chars; citations
    name all hits. A query's hits are as few as top_k. more: columns of hits that are listed in rank order besides."""
    piece = hits.withColumn("piece", F.concat(F.lit("["), "chunk_id", F.lit("] "), "text"))
    so_far = piece.withColumn("total", F.sum(F.length("piece")).over(Window.partitionBy("qid").orderBy("rank")))
    listed = so_far.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "piece", "total", *more))).alias("h"))
    inside = F.filter("h", lambda x: x["total"] <= max_chars)
    return listed.select("qid", F.array_join(F.transform(inside, lambda x: x["piece"]), "\n\n").alias("context_text"), F.transform("h", lambda x: x["chunk_id"]).alias("citations"), *[F.col("h")[c].alias(c) for c in more])


def answer_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(ANSWER_PROMPT + "CONTEXT:\n"), context, F.lit("\n\nQUESTION:\n"), question, F.lit("\n\nANSWER:"))


def summary_prompt(context: Column) -> Column:
    return F.concat(F.lit(SUMMARY_PROMPT + "CONTEXT:\n"), context, F.lit("\n\nSUMMARY:"))


def extract_prompt(context: Column) -> Column:
    return F.concat(F.lit(EXTRACT_PROMPT + "CONTEXT:\n"), context, F.lit("\n\nEXTRACT:"))


def prompt_for(intent_: Column, question: Column, context: Column) -> Column:
    return F.when(intent_ == "summarize", summary_prompt(context)).when(intent_ == "extract", extract_prompt(context)).otherwise(answer_prompt(question, context))


def tagged_block(prompt: Column, tag: str) -> Column:
    """What follows a tag, up to the next of the tags CONTEXT, QUESTION and ANSWER at a line's start, or to the end."""
    return strip(F.regexp_extract(prompt, rf"(?s){tag}:\s*(.*?)(?=\n(?:{'|'.join(PROMPT_TAGS)}):|\z)", 1))


def _cited(parts: Column, joiner: str) -> Column:
    return F.array_join(F.transform(parts, lambda s: F.concat(s, F.lit(" [doc]"))), joiner)


def extractive_answer(question: Column, context: Column) -> Column:
    """The two sentences of the context that share most distinct tokens with the question, ties in order."""
    own = token_set(question, ANSWER_STOP)
    scored = F.transform(sentences(context), lambda s, i: F.struct((-F.size(F.array_intersect(own, tokens(s)))).alias("neg"), i.alias("i"), s.alias("s")))
    best = F.filter(F.slice(F.array_sort(scored), 1, 2), lambda x: x["neg"] < 0)
    return F.when(F.size(best) > 0, _cited(F.transform(best, lambda x: x["s"]), " ")).otherwise(F.lit(NO_EVIDENCE))


def summary(context: Column, n: int = 3) -> Column:
    first = F.slice(sentences(context), 1, n)
    return F.when(F.size(first) > 0, _cited(first, " ")).otherwise(F.lit(NO_SUMMARY))


def extract_fields(context: Column) -> Column:
    """The first ten lines of the form key: value."""
    lines = F.filter(F.split(context, _LINES, -1), lambda x: x.rlike(FIELD))
    fields = F.transform(F.slice(lines, 1, 10), lambda x: F.concat(strip(F.regexp_extract(x, FIELD, 1)), F.lit(": "), strip(F.regexp_extract(x, FIELD, 2))))
    return F.when(F.size(fields) > 0, _cited(fields, "\n")).otherwise(F.lit(NO_FIELDS))


def respond_to_prompt(prompt: Column) -> Column:
    """The rule-based answer to a prompt: a summary or fields if the prompt, context included, says so; else extractive."""
    context, low = tagged_block(prompt, "CONTEXT"), F.lower(prompt)
    block = tagged_block(prompt, "QUESTION")
    question = F.when(block != "", block).otherwise(F.substring(prompt, -500, 500))
    some = context != ""
    return (
        F.when(some & F.contains(low, F.lit("summarize")), summary(context))
        .when(some & F.contains(low, F.lit("extract")), extract_fields(context))
        .when(some, extractive_answer(question, context))
        .otherwise(F.lit(NO_CONTEXT))
    )


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in * PRICE_IN + tokens_out * PRICE_OUT) / 1_000_000


def final_answer(draft: Column, needs_review: Column, reason: Column, decision: Column) -> Column:
    """The draft with its disclaimer, or the escalation text where a flagged one isn't approved; no decision rejects."""
    held = needs_review & (F.coalesce(decision, F.lit("reject")) != "approve")
    return F.when(held, F.concat(F.lit(ESCALATED[0]), reason, F.lit(ESCALATED[1]))).otherwise(with_disclaimer(draft))


def with_token_counts(rows: DataFrame, prompt: str, answer: str) -> DataFrame:
    out = rows.withColumn("tokens_in", word_count(F.col(prompt)).cast("long")).withColumn("tokens_out", word_count(F.col(answer)).cast("long"))
    return out.withColumn("cost_usd", half_even(token_cost(F.col("tokens_in"), F.col("tokens_out")), 9))
