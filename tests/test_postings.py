"""The index kept in storage against the plain formula and against ranking by a pass over all texts."""

import random

from pyspark.sql import functions as F

from tessera.operators import chunking, postings, retrieve
from tessera.operators.postings import PostingIndex, add_segment, merge_segments
from tessera.plans.ask import AskOptions, InputPolicy, ask
from test_retrieval import plain_bm25, top


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["the"] * 200
    return [None if k % 31 == 5 else "" if k % 31 == 6 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for k in range(n)]


QUERIES = ["the w1 w2", "w3 w3 w3 the", "", None, "nothing known", "w1", "w17 w9 w40 w2", "the", "W1! w2?"]


def frames(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string").coalesce(2)


def ranked(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append((r.chunk_ord, round(r.score, 8)))
    return out


def test_postings_rank(spark, tmp_path, monkeypatch):
    """Added in segments, searched, merged and searched again: always what a pass over all texts gives."""
    monkeypatch.setattr(postings, "SHARD", 1_500)
    monkeypatch.setattr(postings, "BLOCK", 4)
    path, every = str(tmp_path / "index"), texts(1, 260)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "qid long, query string")
    assert PostingIndex(spark, path).rank(queries).count() == 0
    parts = [every[:150], every[150:170], every[170:175], every[175:]]
    # the same names come again in each
    for number, part in enumerate(parts):
        add_segment(frames(spark, [(f"d{k}", t) for k, t in enumerate(part)]), path, number)
    add_segment(frames(spark, [(f"d{k}", t) for k, t in enumerate(parts[3])]), path, 3)  # again
    index = PostingIndex(spark, path)
    store = index.chunks()
    by_ord = [(r.chunk_ord, r.text) for r in store.orderBy("chunk_ord").collect()]
    assert [t for _, t in by_ord] == [t for t in every if t] and index.n == len(by_ord)
    got = ranked(index.rank(queries))
    for q, query in enumerate(QUERIES):
        scores = plain_bm25(query or "", [t for _, t in by_ord])
        assert got[q] == [(by_ord[k][0], round(scores[k], 8)) for k in top(scores)]
    assert got == ranked(retrieve.bm25_rank(queries, store)) == ranked(retrieve.bm25_rank(queries, store, index))
    assert ranked(index.rank(queries, 3)) == {q: hits[:3] for q, hits in got.items()}
    terms = {r.term: r.df for r in index.dictionary().collect()}
    assert terms["the"] == sum("the" in t.split() for _, t in by_ord)
    # merging leaves results as they are
    assert merge_segments(spark, path, 4, 100) == [1, 2, 3] and merge_segments(spark, path, 5, 100) == []
    merged = PostingIndex(spark, path)
    assert [r.segment for r in merged.live] == [0, 4] and ranked(merged.rank(queries)) == got
    add_segment(frames(spark, [("late", "w1 w1 w1 unheard")]), path, 6)
    late = PostingIndex(spark, path)
    hits = late.rank(spark.createDataFrame([(1, "unheard")], "qid long, query string"), 1).first()
    assert late.chunks().where(F.col("chunk_ord") == hits.chunk_ord).first().doc_id == "late" and hits.chunk_ord > by_ord[-1][0]


def test_postings_read_no_texts(spark, tmp_path):
    """A search reads posting rows and chunk_ord alone, and skips shards that can't reach the n-th score."""
    path = str(tmp_path / "index")
    rows = [(f"d{k}", "common words here" if k % 10 else f"common rare rare rare x{k}") for k in range(200)]
    add_segment(frames(spark, rows), path, 0)
    add_segment(frames(spark, [("far", "common " + "long text of other things " * 20)] * 50), path, 1)
    queries = spark.createDataFrame([(1, "rare common")], "qid long, query string")
    ranking = PostingIndex(spark, path).rank(queries, 5)
    plan = ranking._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [" in plan and not any("text#" in line for line in plan.splitlines() if "Relation" not in line)
    assert [r.score > 0 for r in ranking.collect()] == [True] * 5


def test_postings_in_the_plan(spark, tmp_path):
    """Retrieval and answering take the index kept in storage; chunks of any strategy may be in it."""
    path = str(tmp_path / "index")
    notes = [("a", "Medication: Metformin 500 mg is taken daily by the patient."), ("b", "The garden is green. Nothing else."), ("c", None)]
    add_segment(frames(spark, notes), path, 0, chunking.chunk_hierarchical)
    index = PostingIndex(spark, path)
    queries = spark.createDataFrame([(1, "metformin dose of the patient")], "qid long, query string")
    options = AskOptions(policy=InputPolicy(strict_topic=False))
    said = ask(queries, index.chunks(), index, None, options).first()
    assert "500 mg" in said.draft_answer and said.citations[0].startswith("a#")


def test_segments_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Neither chunks nor postings are shuffled on the way to storage, and a shard's lists are cut by its characters."""
    from pyspark.sql import DataFrameWriter

    monkeypatch.setattr(postings, "SHARD", 500)
    plans, put = {}, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, to: (plans.update({to.split("/")[-2]: self._df._jdf.queryExecution().executedPlan().toString()}), put(self, to))[1])
    path = str(tmp_path / "index")
    add_segment(frames(spark, [(f"d{k}", t) for k, t in enumerate(texts(2, 60))]).withColumn("doc_ord", F.monotonically_increasing_id() % 1000 + F.spark_partition_id() * 1000), path, 0)
    assert not any("Exchange" in plans[c] for c in ("chunks", "postings"))
    lists = PostingIndex(spark, path)._read("postings").collect()
    assert len({r.shard for r in lists}) > 2 and len({(r.shard, r.term) for r in lists}) == len(lists)
    assert all(r.n == len(r.ords) == len(r.tfs) and r.max_tf == max(r.tfs) and r.min_dl == min(r.dls) and all(d > 0 for d in r.ords[1:]) for r in lists)

