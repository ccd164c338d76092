"""Guardrails over requests and answers, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constants import DISCLAIMER, GROUND_STOP, MIN_GROUNDEDNESS, REQUEST_RULES, TOPIC_WORDS
from ..functions.text import claim_groundedness, fixed_digits, half_even, mean_or_one, sentences, strip, token_set, tokens, words_array


@dataclass(frozen=True)
class InputPolicy:
    max_chars: int = 2000
    min_chars: int = 3
    strict_topic: bool = True
    block_injection: bool = True


def check_request(query: Column, policy: InputPolicy | None = None) -> Column:
    """struct(allowed, reason, triggered_rule, metadata): the first rule that holds, in order: too short, too long, an
    injection pattern, off topic. A null request is empty."""
    policy = policy or InputPolicy()
    q = F.coalesce(query, F.lit(""))
    low = F.lower(q)
    none = F.expr("cast(map() as map<string,string>)")

    def verdict(allowed: bool, reason: Column, rule: str | None, metadata: Column = none) -> Column:
        return F.struct(F.lit(allowed).alias("allowed"), reason.alias("reason"), F.lit(rule).cast("string").alias("triggered_rule"), metadata.alias("metadata"))

    out = F.when(F.length(strip(q)) < policy.min_chars, verdict(False, F.lit("Query too short."), "min-length"))
    out = out.when(F.length(q) > policy.max_chars, verdict(False, F.lit(f"Query exceeds {policy.max_chars} characters."), "max-length", F.create_map(F.lit("length"), F.length(q).cast("string"))))
    if policy.block_injection:
        for pattern, rule in REQUEST_RULES:
            out = out.when(low.rlike(pattern), verdict(False, F.lit(f"Blocked: suspected {rule}."), rule, F.create_map(F.lit("pattern"), F.lit(pattern))))
    if policy.strict_topic:
        words = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
        out = out.when(~F.arrays_overlap(words, words_array(TOPIC_WORDS)), verdict(False, F.lit("Query does not appear clinical; strict topic mode is on."), "off-topic"))
    return out.otherwise(verdict(True, F.lit("OK"), None))


def has_citation(answer: Column) -> Column:
    return F.contains(answer, F.lit("[doc]")) | F.contains(answer, F.lit("[no-"))


def with_disclaimer(answer: Column) -> Column:
    """The answer and the disclaimer, unless it is empty or has one."""
    plain = (answer == "") | F.contains(F.lower(answer), F.lit("disclaimer"))
    return F.when(plain, answer).otherwise(F.concat(F.regexp_replace(answer, r"(?U)[\s\x1c-\x1f]+$", ""), F.lit(DISCLAIMER)))


def check_answer(answer: Column, context: Column, leaks: Column | None = None, min_groundedness: float = MIN_GROUNDEDNESS, require_citations: bool = True, add_disclaimer: bool = True) -> Column:
    """struct(allowed, reason, groundedness, issues, final_text).

    groundedness is the mean share of tokens that the context has, over sentences with more than three distinct tokens
    that are no stop words, or 1 if there are none. leaks: a column with the number of raw values in the answer.
    """
    context_tokens = token_set(context, GROUND_STOP)
    claims = F.filter(sentences(answer), lambda s: F.size(token_set(s, GROUND_STOP)) > 3)
    ground = mean_or_one(F.transform(claims, lambda s: claim_groundedness(s, context_tokens)))
    issues = [F.when(ground < min_groundedness, F.concat(F.lit("Low groundedness "), fixed_digits(ground, 2), F.lit(f" < {min_groundedness:.2f}")))]
    if require_citations:
        issues.append(F.when(~has_citation(answer), F.lit("Missing source citations")))
    if leaks is not None:
        issues.append(F.when(leaks > 0, F.concat(F.lit("PII leak detected: "), leaks.cast("string"), F.lit(" raw value(s) in output"))))
    found = F.array_compact(F.array(*issues))
    fine = F.size(found) == 0
    return F.struct(
        fine.alias("allowed"),
        F.when(fine, F.lit("OK")).otherwise(F.array_join(found, "; ")).alias("reason"),
        half_even(ground, 3).alias("groundedness"),
        found.alias("issues"),
        (F.when(fine, with_disclaimer(answer)).otherwise(answer) if add_disclaimer else answer).alias("final_text"),
    )


def token_overlap(a: Column, b: Column, stop: list[str]) -> Column:
    return F.size(F.array_intersect(token_set(a, stop), tokens(b)))
