"""The registered queries over the driver's tables, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import privacy as P
from ..functions.arrays import exploded
from ..functions.constants import GROUND_STOP
from ..functions.text import claim_groundedness, half_even, sentences, sentences_and_lines, token_set, tokens, word_count
from ..operators import answer as A
from ..operators import audit, chunking, evaluate, postings, retrieve, service
from ..operators.guardrails import InputPolicy, check_answer, check_request, with_disclaimer
from ..operators.index import cosine, hashed_weights, lexical_index, store_stats, with_order
from ..operators.leaks import leaks_between
from ..sources.io import read_table
from ..sources.session import new_folder
from .ask import AskOptions, ask, qa_turns
from .serve import audit_cases, audit_records, run_examples, serve

#: Types and thresholds of the scans: with cards, and with names but those found by two capitals alone.
SCAN_TYPES = ("SSN", "PHONE", "EMAIL", "MRN", "DATE", "PERSON", "ZIP", "CREDIT_CARD")
SCAN_THRESHOLDS = {"PERSON": 0.7}
SALT = "0123456789abcdef"
_JOIN = "\x1f"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "text")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return with_order(chunking.chunk_fixed(_docs(spark, d)))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return qa_turns(read_table(spark, d, "conversations"))


def _joined(c) -> F.Column:
    return F.array_join(c, _JOIN)


def term_postings(spark, d):
    p = lexical_index(_chunks(spark, d)).postings
    return p.select("term", "chunk_ord", "tf", F.col("dl").cast("long").alias("dl"))


def term_dictionary(spark, d):
    x = lexical_index(_chunks(spark, d)).dictionary
    return x.select("term", "df", F.round("idf", 9).alias("idf"))


def bm25_topk(spark, d):
    chunks = _chunks(spark, d)
    return retrieve.bm25_rank(_queries(spark, d), chunks).select("qid", "chunk_ord", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def _stored_index(spark, d):
    """An index in storage: English documents, then two segments of the others, which are merged."""
    folder, docs = new_folder(spark, "index"), read_table(spark, d, "documents").withColumn("doc_ord", F.col("doc_id"))
    other = F.coalesce(F.col("lang") != "en", F.lit(True))
    for number, part in enumerate((~other, other & (F.col("lang") == "de"), other & F.coalesce(F.col("lang") != "de", F.lit(True)))):
        postings.add_segment(docs.where(part).select("doc_id", "doc_ord", "text"), folder, number)
    sizes = [r.n for r in postings.PostingIndex(spark, folder).live]
    postings.merge_segments(spark, folder, len(sizes), sizes[0])
    return postings.PostingIndex(spark, folder)


def bm25_postings(spark, d):
    """BM25 over posting lists in storage, without a pass over texts."""
    top = _stored_index(spark, d).rank(_queries(spark, d))
    return top.select("qid", "chunk_ord", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def index_terms(spark, d):
    """The dictionary of the index in storage: frequencies are sums over its segments."""
    return _stored_index(spark, d).dictionary().select("term", "df", F.round("idf", 9).alias("idf"))


def hash_embed(spark, d):
    return hashed_weights(_docs(spark, d), "doc_id").select("doc_id", "bucket", F.round("w", 9).alias("w"))


def dense_topk(spark, d):
    return retrieve.dense_rank(_queries(spark, d), _chunks(spark, d)).select("qid", "chunk_ord", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def rrf_fusion(spark, d):
    chunks, q = _chunks(spark, d), _queries(spark, d)
    fused = retrieve.fuse(retrieve.dense_rank(q, chunks), retrieve.bm25_rank(q, chunks))
    return fused.select("qid", "chunk_ord", F.round("fused", 9).alias("fused"), F.col("fused_rank").cast("int").alias("fused_rank"))


def hybrid_retrieve(spark, d):
    chunks = _chunks(spark, d)
    hits = retrieve.hybrid(_queries(spark, d), chunks)
    return hits.select("qid", "chunk_id", "doc_id", "text", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"), "source")


def rerank(spark, d):
    chunks, q = _chunks(spark, d), _queries(spark, d)
    top = retrieve.bm25_rank(q, chunks).select("qid", "chunk_ord", F.col("rank").alias("fused_rank"))
    return retrieve.rerank(q, top, chunks).select("qid", "chunk_ord", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))


def vector_topk(spark, d):
    rows = read_table(spark, d, "embeddings").where("vec_id is not null and embedding is not null")
    q = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"))
    top = retrieve.vector_rank(q, rows.select(F.col("vec_id").alias("chunk_ord"), F.col("embedding").alias("v")), 10)
    return top.select("qid", F.col("chunk_ord").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def vector_cosine(spark, d):
    rows = read_table(spark, d, "embeddings")
    return rows.select("vec_id", F.round(cosine(F.col("embedding"), F.reverse("embedding")), 9).alias("cosine"))


def retrieval_metrics(spark, d):
    """Vectors of a query's label are relevant to it."""
    rows = read_table(spark, d, "embeddings").where("vec_id is not null and embedding is not null").select("vec_id", "label", "embedding")
    q = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("q_label"), F.col("embedding").alias("v"))
    top = retrieve.vector_rank(q.select("qid", "v"), rows.select(F.col("vec_id").alias("chunk_ord"), F.col("embedding").alias("v")), 10)
    hits = top.join(rows.select(F.col("vec_id").alias("chunk_ord"), "label"), "chunk_ord").join(q.select("qid", "q_label"), "qid")
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_ord", (F.col("label") == F.col("q_label")).alias("good")))).alias("h"))
    runs = listed.select(F.transform("h", lambda x: x["chunk_ord"]).alias("retrieved"), F.transform(F.filter("h", lambda x: x["good"]), lambda x: x["chunk_ord"]).alias("relevant"))
    return evaluate.evaluate_run(runs)


def chunk_fixed(spark, d):
    return chunking.chunk_fixed(_docs(spark, d)).select("doc_id", "idx", "chunk_id", "text", "start", F.col("end").alias("stop"), "strategy")


def chunk_semantic(spark, d):
    return chunking.chunk_semantic(_docs(spark, d)).withColumnRenamed("end", "stop")


def chunk_hierarchical(spark, d):
    return chunking.chunk_hierarchical(_docs(spark, d)).withColumnRenamed("end", "stop")


def section_split(spark, d):
    return exploded(_docs(spark, d), ["doc_id"], chunking.sections(F.col("text")), "section", "pos")


def sentence_split(spark, d):
    return exploded(_docs(spark, d), ["doc_id"], sentences(F.col("text")), "sentence", "pos")


def sentence_line_split(spark, d):
    return exploded(_docs(spark, d), ["doc_id"], sentences_and_lines(F.col("text")), "sentence", "pos")


def chunk_stats(spark, d):
    return store_stats(_chunks(spark, d))


def chunk_lookup(spark, d):
    chunks = _chunks(spark, d)
    return retrieve.chunk_by_id(chunks, "1#c0").select("chunk_id", "doc_id", "text")


def input_guardrail(spark, d):
    rows = read_table(spark, d, "conversations").select("conv_id", "turn", check_request(F.col("text")).alias("v"))
    return rows.select("conv_id", "turn", "v.allowed", "v.reason", "v.triggered_rule", F.concat(F.array_join(F.map_keys("v.metadata"), ","), F.lit("="), F.array_join(F.map_values("v.metadata"), ",")).alias("metadata"))


def request_intent(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", A.intent(F.col("text")).alias("intent"))


def _scan(spark, d):
    return _docs(spark, d).withColumn("spans", P.pii_spans(F.coalesce("text", F.lit("")), SCAN_TYPES, SCAN_THRESHOLDS))


def pii_spans(spark, d):
    rows = exploded(_scan(spark, d), ["doc_id"], F.col("spans"), "s")
    return rows.select("doc_id", "s.entity_type", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.col("s.text").alias("span"), "s.confidence", "s.detector")


def pii_counts(spark, d):
    rows = exploded(_scan(spark, d), [], F.col("spans"), "s")
    return rows.groupBy("s.entity_type").agg(F.count("*").alias("n"))


def pii_default_types(spark, d):
    """The default configuration, with names by two capitals."""
    rows = _docs(spark, d).select("doc_id", P.type_counts(P.pii_spans(F.coalesce("text", F.lit("")))).alias("m"))
    return rows.select("doc_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("types"))


def _redacted(spark, d):
    rows = _scan(spark, d).withColumn("names", P.placeholders(F.col("spans")))
    return rows.withColumn("entries", P.redaction_entries(F.col("spans"), F.col("names"))).withColumn("redacted", P.redact(F.coalesce("text", F.lit("")), F.col("spans"), F.col("names")))


def pii_redact(spark, d):
    return _redacted(spark, d).select("doc_id", "redacted")


def pii_map(spark, d):
    return exploded(_redacted(spark, d), ["doc_id"], F.col("entries"), "e").select("doc_id", "e.placeholder", "e.original")


def pii_seal(spark, d):
    return _redacted(spark, d).select("doc_id", P.seal(F.col("entries"), F.lit(SALT)).alias("seal"))


def pii_restore(spark, d):
    return _redacted(spark, d).select("doc_id", P.restore(F.col("redacted"), F.col("entries")).alias("restored"))


def leak_scan(spark, d):
    """Each document's whole text as an answer against its own map: what it leaks."""
    rows = _redacted(spark, d)
    return rows.select("doc_id", F.array_join(P.leaked_types(F.col("text"), F.col("entries")), ",").alias("leaked"), P.leak_count(F.col("text"), F.col("entries")).cast("long").alias("n_leaked"))


def leak_across(spark, d):
    """Each document's whole text as an answer against the maps of all documents: how many originals it holds."""
    originals = exploded(_redacted(spark, d), [], F.col("entries"), "e").select("e.original")
    found = leaks_between(_docs(spark, d).withColumnRenamed("doc_id", "answer_id"), originals)
    return found.groupBy("answer_id").agg(F.count("*").alias("n_originals")).withColumnRenamed("answer_id", "doc_id")


def _hits(spark, d):
    chunks = _chunks(spark, d)
    q = _queries(spark, d)
    top = retrieve.bm25_rank(q, chunks, None, 8)
    return top.join(chunks.select("chunk_ord", "chunk_id", "text"), "chunk_ord").select("qid", "rank", "chunk_id", "text")


def context_assembly(spark, d):
    return A.assemble_context(_hits(spark, d)).select("qid", "context_text", _joined("citations").alias("citations"))


def extractive_answer(spark, d):
    return _turns(spark, d).select("conv_id", "turn", A.extractive_answer(F.col("question"), F.col("answer")).alias("reply"))


def summarize(spark, d):
    return _docs(spark, d).select("doc_id", A.summary(F.coalesce("text", F.lit(""))).alias("summary"))


def extract_fields(spark, d):
    return _docs(spark, d).select("doc_id", A.extract_fields(F.coalesce("text", F.lit(""))).alias("fields"))


def prompt_answer(spark, d):
    rows = _turns(spark, d)
    return rows.select("conv_id", "turn", A.respond_to_prompt(A.prompt_for(A.intent(F.col("question")), F.col("question"), F.col("answer"))).alias("reply"))


def prompts(spark, d):
    rows = _turns(spark, d)
    return rows.select("conv_id", "turn", A.answer_prompt(F.col("question"), F.col("answer")).alias("qa"), A.summary_prompt(F.col("answer")).alias("summarize"), A.extract_prompt(F.col("answer")).alias("extract"))


def groundedness(spark, d):
    rows = _turns(spark, d)
    return rows.select("conv_id", "turn", half_even(claim_groundedness(F.col("answer"), token_set(F.col("question"), GROUND_STOP)), 6).alias("groundedness"))


def output_guardrail(spark, d):
    rows = _turns(spark, d).select("conv_id", "turn", check_answer(F.col("answer"), F.col("question")).alias("v"))
    return rows.select("conv_id", "turn", "v.allowed", "v.reason", "v.groundedness", "v.final_text")


def cited_guardrail(spark, d):
    """Answers drawn from their context: grounded and cited."""
    rows = _turns(spark, d).withColumn("reply", A.extractive_answer(F.col("question"), F.col("answer")))
    rows = rows.select("conv_id", "turn", check_answer(F.col("reply"), F.col("answer")).alias("v"))
    return rows.select("conv_id", "turn", "v.allowed", "v.reason", "v.groundedness", "v.final_text")


def respond_hitl(spark, d):
    """Reviewers approve every other conversation."""
    rows = _turns(spark, d).withColumn("v", check_answer(F.col("answer"), F.col("question")))
    decision = F.when(F.col("conv_id") % 2 == 0, F.lit("approve"))
    return rows.select("conv_id", "turn", A.final_answer(F.col("answer"), ~F.col("v.allowed"), F.col("v.reason"), decision).alias("final_answer"))


def disclaimer(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", with_disclaimer(F.col("text")).alias("final_text"))


def token_cost(spark, d):
    rows = _turns(spark, d)
    t_in, t_out = word_count(F.col("question")).cast("long"), word_count(F.col("answer")).cast("long")
    return rows.select("conv_id", "turn", t_in.alias("tokens_in"), t_out.alias("tokens_out"), F.round(A.token_cost(t_in, t_out), 9).alias("cost_usd"))


def ask_batch(spark, d):
    chunks = _chunks(spark, d)
    q = _queries(spark, d)
    options = AskOptions(policy=InputPolicy(strict_topic=False), salt=SALT)
    decisions = q.where("qid % 2 = 0").select("qid", F.lit("approve").alias("decision"))
    out = ask(q, chunks, None, decisions, options)
    return out.withColumn("citations", _joined("citations"))


def _served(spark, d):
    """Benchmark texts as requests with keys, all in one minute: every fifth key is unknown, twenty requests a key pass."""
    chunks = _chunks(spark, d)
    q = _queries(spark, d).withColumn("api_key", F.concat(F.lit("key-"), (F.col("qid") % 5).cast("string"))).withColumn("at", F.col("qid").cast("double") / 100)
    keys = service.key_frame(spark, [f"key-{k}" for k in range(4)])
    return serve(q, keys, chunks, None, None, AskOptions(policy=InputPolicy(strict_topic=False), salt=SALT), 20)


def serve_requests(spark, d):
    return _served(spark, d).withColumn("citations", _joined("citations"))


def serve_audit(spark, d):
    """The log of served requests, sealed, a chain for each key."""
    return audit.seal(audit_records(_served(spark, d), F.col("api_key"), "0.0"))


def example_eval(spark, d):
    """Benchmark texts as examples that must find their first word."""
    chunks = _chunks(spark, d)
    none = F.expr("cast(array() as array<string>)")
    rows = _queries(spark, d).select(F.col("qid").cast("string").alias("id"), "query", F.array(F.lit("#c")).alias("expected_citations"), F.slice(tokens(F.col("query")), 1, 1).alias("must_contain"), none.alias("must_not_contain"), F.lit(0.35).alias("min_groundedness"))
    out = run_examples(rows, chunks, None, AskOptions(policy=InputPolicy(strict_topic=False), salt=SALT))
    return out.withColumn("failures", _joined("failures")).withColumn("citations", _joined("citations"))


def _cases(spark, d):
    rows = _turns(spark, d)
    none = F.expr("cast(array() as array<string>)")
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("question").alias("query"),
        "answer",
        F.col("question").alias("context_text"),
        F.lit(False).alias("blocked"),
        F.lit("").alias("block_reason"),
        word_count(F.col("question")).cast("long").alias("tokens_in"),
        word_count(F.col("answer")).cast("long").alias("tokens_out"),
        F.length("answer").cast("double").alias("latency_ms"),
        none.alias("citations"),
        none.alias("expected_citations"),
        F.slice(tokens(F.col("question")), 1, 2).alias("must_contain"),
        F.array(F.lit("the"), F.lit("zebra")).alias("must_not_contain"),
        F.lit(0.35).alias("min_groundedness"),
    )


def judge(spark, d):
    rows = _cases(spark, d).withColumn("j", evaluate.judge(F.col("answer"), F.col("context_text"), F.col("expected_citations"), F.col("must_contain"), F.col("must_not_contain")))
    return rows.select("id", "j.groundedness", F.size("j.hallucinations").cast("long").alias("n_hallucinations"), F.array_join("j.must_contain_hits", ",").alias("hits"), F.array_join("j.must_contain_misses", ",").alias("misses"), F.array_join("j.forbidden_hits", ",").alias("forbidden"), "j.citation_hit")


def eval_cases(spark, d):
    return evaluate.eval_cases(_cases(spark, d)).select("id", "groundedness", "passed", F.size("failures").cast("long").alias("n_failures"), "latency_ms", F.round("cost_usd", 6).alias("cost_usd"))


def eval_report(spark, d):
    out = evaluate.eval_report(evaluate.eval_cases(_cases(spark, d)))
    return out.select("total", "passed", "pass_rate", "avg_groundedness", "avg_latency_ms", F.round("total_cost_usd", 6).alias("total_cost_usd"))


def regression_gate(spark, d):
    out = evaluate.regression_gate(evaluate.eval_report(evaluate.eval_cases(_cases(spark, d))))
    return out.select("passed", F.array_join("failures", "; ").alias("failures"))


def _requests(spark, d):
    rows = read_table(spark, d, "events")
    return rows.select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


def _records(spark, d):
    """Events as audit records, a chain for each user."""
    rows = _requests(spark, d)
    details = F.create_map(F.lit("user_name"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("type"), F.col("event_type"))
    return rows.select(
        F.col("user_id").cast("string").alias("log_id"),
        F.row_number().over(_by_user()).cast("long").alias("seq"),
        F.col("event_type").alias("event"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.lit("system").alias("actor"),
        audit.scrub(details).alias("details"),
        F.format_string("%.6f", "at").alias("ts"),
        F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 12).alias("record_id"),
    )


def _by_user():
    return Window.partitionBy("user_id").orderBy("at", "event_id")


def audit_scrub(spark, d):
    return _records(spark, d).select("request_id", F.col("details")["user_name"].alias("user_name"), F.col("details")["type"].alias("type"))


def audit_seal(spark, d):
    return audit.seal(_records(spark, d)).select("log_id", "seq", "prev_hash", "record_hash")


def audit_verify(spark, d):
    """Sealed chains, in which every tenth user's third record was changed and every tenth-and-one's second deleted."""
    sealed = audit.seal(_records(spark, d))
    user = F.col("log_id").cast("long")
    forged = sealed.withColumn("actor", F.when((user % 10 == 0) & (F.col("seq") == 3), F.lit("intruder")).otherwise(F.col("actor")))
    return audit.verify(forged.where(~((user % 10 == 1) & (F.col("seq") == 2))))


def audit_append(spark, d):
    """Chains sealed in three batches by day, each behind the last one's heads; the second brings the first one's again."""
    rows = _records(spark, d)
    day = F.dayofmonth(F.timestamp_seconds(F.col("ts").cast("double")))
    first = audit.seal(rows.where(day <= 10))
    second = audit.seal(rows.where(day <= 20), audit.heads(first))
    sealed = first.unionByName(second)
    sealed = sealed.unionByName(audit.seal(rows.where(day > 20), audit.heads(sealed)))
    return sealed.select("log_id", "seq", "prev_hash", "record_hash")


def audit_details(spark, d):
    """Details of several types: numbers, booleans, lists and nested objects, with a text that hints at a person hidden."""
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    rows = read_table(spark, d, "events").select("event_id", F.struct(F.col("event_type").alias("type"), F.col("value").alias("value"), (F.col("value") > 20).alias("large"), F.parse_json("props").alias("props"), F.array(F.col("user_id"), F.lit(None)).alias("users"), name.alias("user_name")).alias("details"))
    return rows.select("event_id", audit.details_json(F.col("details"), rows.schema["details"].dataType, True).alias("details"))


def eval_audit(spark, d):
    """Judged cases as audit records."""
    cases = evaluate.eval_cases(_cases(spark, d))
    place = F.split("id", "-")
    return audit_cases(cases, "eval", "0.0", place[0].cast("long") * 1000 + place[1].cast("long")).drop("record_id")


def rate_limit(spark, d):
    """Ten requests a minute for each user."""
    out = service.rate_limit(_requests(spark, d).withColumn("at", F.col("at") / 60), 10)
    return out.select("user_id", "event_id", "allowed")


def _observed(spark, d):
    rows = _requests(spark, d)
    return rows.select(F.round("value", 2).alias("latency_ms"), (F.col("event_type") == "error").alias("blocked"), (F.col("value") > 100).alias("needs_hitl"), (F.col("event_id") % 50).alias("tokens_in"), (F.col("event_id") % 7).alias("tokens_out"))


def service_metrics(spark, d):
    return service.service_metrics(_observed(spark, d)).withColumn("latency_avg_ms", F.round("latency_avg_ms", 4))


def prometheus(spark, d):
    return service.prometheus_text(service.service_metrics(_observed(spark, d)))


def sse_deltas(spark, d):
    rows = read_table(spark, d, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return service.sse_events(rows, "id", "text")


def api_keys(spark, d):
    requests = _requests(spark, d).select("event_id", F.concat(F.lit("key-"), (F.col("user_id") % 20).cast("string")).alias("api_key"))
    keys = service.key_frame(spark, [f"key-{k}" for k in range(0, 20, 3)])
    return service.authorise(requests, keys).select("event_id", "authorised")


def parent_links(spark, d):
    """Children with the parent each belongs to, brought together by the parent's id; chunks are made once. Ids that repeat pair
    each parent with each child."""
    rows = chunking.chunk_hierarchical(_docs(spark, d))
    parent = F.col("level") == "parent"
    met = rows.select(F.when(parent, F.col("chunk_id")).otherwise(F.col("parent_id")).alias("pid"), parent.alias("parent"), "text").where("pid is not null")
    met = met.groupBy("pid").agg(F.collect_list(F.when(F.col("parent"), F.col("text"))).alias("p"), F.collect_list(F.when(~F.col("parent"), F.col("text"))).alias("c"))
    inside = F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + F.size(F.filter("c", lambda c: F.contains(p, c))))
    return met.where("size(p) > 0 and size(c) > 0").select("pid", (F.size("p").cast("long") * F.size("c")).alias("children"), inside.alias("inside"))


_NAMED = (
    bm25_topk, bm25_postings, index_terms, term_postings, term_dictionary, hash_embed, dense_topk, rrf_fusion, rerank, hybrid_retrieve, vector_topk, vector_cosine, retrieval_metrics,
    chunk_fixed, chunk_semantic, chunk_hierarchical, parent_links, section_split, sentence_split, sentence_line_split, chunk_stats, chunk_lookup,
    input_guardrail, request_intent, pii_spans, pii_counts, pii_default_types, pii_redact, pii_map, pii_seal, pii_restore, leak_scan, leak_across,
    context_assembly, extractive_answer, summarize, extract_fields, prompt_answer, prompts, groundedness, output_guardrail, cited_guardrail, respond_hitl, disclaimer,
    token_cost, ask_batch, serve_requests, serve_audit, example_eval, judge, eval_cases, eval_report, regression_gate,
    audit_scrub, audit_seal, audit_append, audit_details, eval_audit, audit_verify, rate_limit, service_metrics, prometheus, sse_deltas, api_keys,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMED}
