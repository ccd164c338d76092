"""Evaluation: retrieval metrics, judged answers, reports and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import GATE, GROUND_STOP
from ..functions.text import claim_groundedness, half_even, mean_or_one, sentences, token_set, word_count
from .answer import token_cost


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Relevant ones among the first k, over how many there are; 0 for none."""
    top = F.slice(retrieved, 1, k)
    return F.when(F.size(top) == 0, F.lit(0.0)).otherwise(F.size(F.filter(top, lambda x: F.array_contains(relevant, x))) / F.size(top))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.when(F.size(relevant) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / F.size(F.array_distinct(relevant)))


def hit_at(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.when(F.arrays_overlap(F.slice(retrieved, 1, k), relevant), F.lit(1.0)).otherwise(F.lit(0.0))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(places) > 0, 1.0 / F.element_at(places, 1)).otherwise(F.lit(0.0))


def evaluate_run(runs: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row of means over runs (retrieved, relevant: arrays): precision, recall and hit rate at each k, and mrr; zeros
    for no runs."""
    r, s = F.col("retrieved"), F.col("relevant")
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias(name)
    out = [mean(f(r, s, k), f"{n}_at_{k}") for k in ks for n, f in (("precision", precision_at), ("recall", recall_at), ("hit_rate", hit_at))]
    return runs.agg(*out, mean(reciprocal_rank(r, s), "mrr"))


def judge(answer: Column, context: Column, expected: Column, must: Column, must_not: Column) -> Column:
    """struct(groundedness, sentence_scores, hallucinations, must_contain_hits, must_contain_misses, forbidden_hits,
    citation_hit). Sentences of more than three words count; those under 0.2 are hallucinations."""
    known = token_set(context, GROUND_STOP)
    scored = F.transform(F.filter(sentences(answer), lambda s: word_count(s) > 3), lambda s: F.struct(s.alias("s"), claim_groundedness(s, known).alias("g")))
    low = F.lower(answer)
    inside = lambda m: F.contains(low, F.lower(m))
    return F.struct(
        half_even(mean_or_one(F.transform(scored, lambda x: x["g"])), 3).alias("groundedness"),
        F.transform(scored, lambda x: half_even(x["g"], 3)).alias("sentence_scores"),
        F.transform(F.filter(scored, lambda x: x["g"] < 0.2), lambda x: x["s"]).alias("hallucinations"),
        F.filter(must, inside).alias("must_contain_hits"),
        F.filter(must, lambda m: ~inside(m)).alias("must_contain_misses"),
        F.filter(must_not, inside).alias("forbidden_hits"),
        ((F.size(expected) == 0) | F.exists(expected, lambda c: F.contains(answer, c))).alias("citation_hit"),
    )


def eval_cases(rows: DataFrame) -> DataFrame:
    """Judged cases of rows (id, query, answer, context_text, blocked, block_reason, tokens_in, tokens_out, latency_ms,
    citations, expected_citations, must_contain, must_not_contain, min_groundedness)."""
    judged = rows.withColumn("j", judge(F.col("answer"), F.col("context_text"), F.col("expected_citations"), F.col("must_contain"), F.col("must_not_contain")))
    failures = F.concat(
        F.array_compact(
            F.array(
                F.when(F.col("blocked"), F.concat(F.lit("blocked: "), "block_reason")),
                F.when(F.col("j.groundedness") < F.col("min_groundedness"), F.concat(F.lit("groundedness "), F.col("j.groundedness").cast("string"), F.lit(" < "), F.col("min_groundedness").cast("string"))),
            )
        ),
        F.transform("j.must_contain_misses", lambda m: F.concat(F.lit("missing fact: "), m)),
        F.transform("j.forbidden_hits", lambda m: F.concat(F.lit("forbidden fact present: "), m)),
        F.array_compact(
            F.array(
                F.when(F.size("j.hallucinations") > 0, F.concat(F.size("j.hallucinations").cast("string"), F.lit(" ungrounded sentence(s)"))),
                F.when(~F.col("j.citation_hit") & (F.size("expected_citations") > 0), F.lit("expected citation not found in answer")),
            )
        ),
    )
    return judged.select(
        "id",
        "query",
        F.col("j.groundedness").alias("groundedness"),
        (F.size(failures) == 0).alias("passed"),
        failures.alias("failures"),
        half_even(F.col("latency_ms"), 1).alias("latency_ms"),
        half_even(token_cost(F.col("tokens_in"), F.col("tokens_out")), 6).alias("cost_usd"),
        "citations",
    )


def eval_report(cases: DataFrame) -> DataFrame:
    """One row: total, passed, pass_rate, avg_groundedness, avg_latency_ms, total_cost_usd."""
    n = F.greatest(F.count("*"), F.lit(1))
    share = lambda c, digits: half_even(F.coalesce(F.sum(c), F.lit(0.0)) / n, digits)
    return cases.agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        half_even(F.count_if("passed") / n, 3).alias("pass_rate"),
        share("groundedness", 3).alias("avg_groundedness"),
        share("latency_ms", 1).alias("avg_latency_ms"),
        half_even(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"),
    )


def regression_gate(report: DataFrame, baseline: dict[str, float] | None = None) -> DataFrame:
    """passed and failures of a one-row report against thresholds; a missing metric counts as 0."""
    limit = GATE | (baseline or {})
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in report.columns else F.lit(0.0)
    tests = (
        ("pass_rate", value("pass_rate") < limit["min_pass_rate"], "<", "min_pass_rate"),
        ("avg_groundedness", value("avg_groundedness") < limit["min_groundedness"], "<", "min_groundedness"),
        ("avg_latency_ms", value("avg_latency_ms") > limit["max_latency_ms"], ">", "max_latency_ms"),
    )
    found = F.array_compact(F.array(*[F.when(test, F.lit(f"{name} {sign} {float(limit[key])}")) for name, test, sign, key in tests]))
    return report.select((F.size(found) == 0).alias("passed"), found.alias("failures"))
