"""A lexical index kept in storage: segments of chunks with their posting lists, searched by BM25 without their texts.

Adding documents writes a segment of its own and touches no other; frequencies and lengths of the corpus are sums over
segments. A segment's chunks are cut into shards as they lie in its files. A posting row holds what one shard has of one term:

    chunks/segment=K      the chunks
    postings/segment=K    shard, term, n, max_tf, min_dl, ords (differences of chunk_ord), tfs, dls; sorted by term in a shard
    terms/segment=K       term, df
    stats/segment=K       one row: n, total, last_doc, replaces; written last, so that a segment is there once this is

All are Parquet tables at plain paths. Writing a segment again replaces it by the same. A shard's postings are made by the task
that reads its chunks, so neither texts nor postings are shuffled on the way in; only counts of terms are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.session import ship
from .chunking import chunk_fixed
from .index import PER_DOC, numbered, split_tokens, with_order

K1, B = 1.5, 0.75
#: Characters of a shard's chunks, and queries that meet a shard in one task.
SHARD, BLOCK = 8_000_000, 256
#: Posting rows that a worker lays out at a time.
ROWS = 10_000
#: Scores are compared after rounding, and bounds allow for that.
DIGITS, SLACK = 9, 1e-8
STATS = "n bigint, total bigint, last_doc bigint, replaces array<bigint>"
KEY = ["segment", "shard"]
POSTINGS = "shard bigint, term string, n int, max_tf int, min_dl int, ords array<bigint>, tfs array<int>, dls array<int>"


def _stats(spark: SparkSession, path: str) -> list:
    """The row of each segment that no other replaces, by number."""
    try:
        rows = spark.read.schema(f"{STATS}, segment bigint").parquet(f"{path}/stats").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    gone = {k for r in rows for k in r.replaces}
    return sorted((r for r in rows if r.segment not in gone), key=lambda r: r.segment)


def _lists(shard: int, ords: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """The posting rows of a shard's chunks, by term."""
    flat, owner, lengths = split_tokens(texts)
    coded = flat.dictionary_encode()
    by_term = np.argsort(np.array(coded.dictionary.to_pylist(), object), kind="stable")
    term_of = np.empty(len(by_term), np.int64)
    term_of[by_term] = np.arange(len(by_term))
    # places of chunks in order of chunk_ord; rows that share one stay apart
    order = np.argsort(ords, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ords, lengths = ords[order], lengths[order]
    pairs, tf = np.unique(term_of[coded.indices.to_numpy(zero_copy_only=False)] * max(1, len(ords)) + place[owner], return_counts=True)
    term, chunk = pairs // max(1, len(ords)), pairs % max(1, len(ords))
    starts, terms = np.searchsorted(term, np.arange(len(by_term) + 1)), coded.dictionary.take(pa.array(by_term)).cast(pa.string())
    for lo in range(0, len(by_term), ROWS):
        ends = starts[lo : lo + ROWS + 1]
        at, first = slice(ends[0], ends[-1]), ends[:-1] - ends[0]
        tfs, dls, gaps = tf[at], lengths[chunk[at]], np.diff(ords[chunk[at]], prepend=0)
        gaps[first] = ords[chunk[at]][first]
        many = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(x, kind))
        one = lambda x: pa.array(x, pa.int32())
        columns = [pa.array(np.full(len(first), shard)), terms.slice(lo, ROWS), one(np.diff(ends)), one(np.maximum.reduceat(tfs, first)), one(np.minimum.reduceat(dls, first)), many(gaps, pa.int64()), many(tfs, pa.int32()), many(dls, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "term", "n", "max_tf", "min_dl", "ords", "tfs", "dls"])


def _posted(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Posting rows of chunks (chunk_ord, text), whose task begins a new shard once one has `size` characters. Chunks without a
    chunk_ord, which no search can name, count as -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, ords, texts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for ord_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ords.append(-1 if ord_ is None else ord_)
                texts.append(text)
                held += len(text)
                if held >= size:
                    yield from _lists(shard, np.array(ords, np.int64), texts)
                    shard, held, ords, texts = shard + 1, 0, [], []
        if ords:
            yield from _lists(shard, np.array(ords, np.int64), texts)

    return run


def _write(chunks: DataFrame, path: str, number: int, replaces: list[int]) -> None:
    spark = chunks.sparkSession
    ship(spark)
    put = lambda rows, name: rows.write.mode("overwrite").parquet(f"{path}/{name}/segment={number}")
    put(chunks, "chunks")
    chunks = spark.read.schema(chunks.schema).parquet(f"{path}/chunks/segment={number}")
    put(chunks.select("chunk_ord", F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(_posted(SHARD), POSTINGS), "postings")
    lists = spark.read.schema(POSTINGS).parquet(f"{path}/postings/segment={number}")
    put(lists.groupBy("term").agg(F.sum("n").alias("df")), "terms")
    last = F.coalesce(F.max(F.expr(f"chunk_ord div {PER_DOC}")), F.lit(-1))
    # a chunk has as many tokens as its terms occur in it
    words = lists.agg(F.coalesce(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda n, tf: n + tf)), F.lit(0)).alias("total"))
    totals = chunks.agg(F.count("*").alias("n"), last.alias("last_doc")).crossJoin(words).select("n", "total", "last_doc")
    put(totals.withColumn("replaces", F.lit(replaces).cast("array<bigint>")).coalesce(1), "stats")


def add_segment(docs: DataFrame, path: str, number: int, chunker: Callable[..., DataFrame] = chunk_fixed, **options) -> None:
    """Chunks documents (doc_id, text) and writes them as a segment behind those of lower numbers. An id that is there already
    is added again, behind all others. Numbers rise; the cost depends on the documents added alone. Documents that have a
    doc_ord, by which chunks are ordered, keep it; it has to be unique over all segments."""
    if "doc_ord" not in docs.columns:
        before = [r.last_doc for r in _stats(docs.sparkSession, path) if r.segment < number]
        docs = numbered(docs, max(before, default=-1) + 1)
    chunks = chunker(docs, **options)
    chunks = with_order(chunks if "idx" in chunks.columns else chunks.withColumn("idx", F.col("ord")))
    _write(chunks, path, number, [])


def merge_segments(spark: SparkSession, path: str, number: int, smaller_than: int) -> list[int]:
    """Writes all segments of fewer chunks than given as one, and returns their numbers; nothing if there are fewer than two.
    They stay where they are, and are read no more. Chunks keep their chunk_ord, so that results stay the same."""
    small = [r for r in _stats(spark, path) if r.n < smaller_than and r.segment < number]
    if len(small) < 2:
        return []
    # read at once, small files are packed into tasks, and so into shards
    chunks = spark.read.option("basePath", f"{path}/chunks").option("mergeSchema", True).parquet(*[f"{path}/chunks/segment={r.segment}" for r in small])
    _write(chunks.drop("segment"), path, number, [r.segment for r in small])
    return [r.segment for r in small]


@dataclass
class PostingIndex:
    """The live segments of an index."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        ship(self.spark)
        self.live = _stats(self.spark, self.path)
        self.n, total = sum(r.n for r in self.live), sum(r.total for r in self.live)
        self.avgdl = total / max(1, self.n) or 1.0

    def _read(self, name: str) -> DataFrame:
        # only folders of live segments are listed
        paths = [f"{self.path}/{name}/segment={r.segment}" for r in self.live]
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").option("mergeSchema", name == "chunks").parquet(*paths)
        return rows.withColumn("segment", F.col("segment").cast("long"))

    def chunks(self) -> DataFrame:
        return self._read("chunks").drop("segment")

    def dictionary(self) -> DataFrame:
        """(term, df, idf) over all segments."""
        return self._weighed(self._read("terms"))

    def _weighed(self, terms: DataFrame) -> DataFrame:
        df = F.col("df")
        return terms.groupBy("term").agg(F.sum("df").alias("df")).withColumn("idf", F.log(1 + (F.lit(self.n) - df + 0.5) / (df + 0.5)))

    def _gain(self, tf: Column, dl: Column) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.greatest(dl, F.lit(1)) / F.lit(self.avgdl)))

    def rank(self, queries: DataFrame, n: int = 20) -> DataFrame:
        """(qid, chunk_ord, score, rank) of queries (qid, query): the n best by BM25, ties by chunk order; chunks of score 0
        fill a list up.

        Of the postings, only those of the queries' terms are read. For each query, the most that a shard can give follows
        from its terms' highest frequencies and shortest chunks there. A query first meets the shard of the highest bound;
        its n-th score there goes with it, and only shards whose bound reaches that score are met besides. Queries meet a
        shard in blocks, to which its rows of their terms are sent once. What is cached is as small as the queries: their
        terms, the bounds of shards for them, first hits and best ones.
        """
        asked = queries.select(F.col("qid").cast("long").alias("qid"), F.explode(tokens(F.coalesce("query", F.lit("")))).alias("term"))
        if not self.n:
            return self.spark.createDataFrame([], "qid long, chunk_ord long, score double, rank int")
        known = self._weighed(self._read("terms").join(asked.select("term").distinct(), "term", "left_semi"))
        weights = asked.groupBy("qid", "term").agg(F.count("*").alias("times")).join(known, "term").select("qid", "term", (F.col("times") * F.col("idf")).alias("w")).persist()
        weights.count()  # once they are there, their size decides on how they are joined
        lists = self._read("postings")
        most = weights.join(lists.select("term", *KEY, self._gain(F.col("max_tf"), F.col("min_dl")).alias("gain")), "term")
        most = most.groupBy("qid", *KEY).agg(F.sum(F.col("w") * F.col("gain")).alias("most")).persist()
        most.count()
        blocks = max(1, -(-queries.count() // BLOCK))
        avgdl = self.avgdl

        def score(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            theirs = theirs[theirs["term"].isin(mine["term"])]  # other queries of the block may go elsewhere
            if not len(mine) or not len(theirs):
                return pd.DataFrame({"qid": [], "chunk_ord": [], "score": []})
            ords = [np.cumsum(x) for x in theirs["ords"]]
            owner, place = np.unique(np.concatenate(ords), return_inverse=True)
            qids, row = np.unique(mine["qid"].to_numpy(), return_inverse=True)
            least = np.full(len(qids), -np.inf)
            least[row] = mine["least"].to_numpy()
            wanted = {t: (row[at], mine["w"].to_numpy()[at]) for t, at in mine.groupby("term").indices.items()}
            scores, at = np.zeros((len(qids), len(owner))), 0
            for term, here, tf, dl in zip(theirs["term"], ords, theirs["tfs"], theirs["dls"], strict=True):
                found = place[at : at + len(here)]
                at += len(here)
                who, w = wanted[term]
                scores[np.ix_(who, found)] += w[:, None] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.maximum(1, dl) / avgdl)))
            scores = np.round(scores, DIGITS)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
            kept = np.take_along_axis(scores, best, 1)
            # what rounds to 0 ties with chunks that have none of the terms
            query, column = np.nonzero((kept > 0) & (kept >= least[:, None]))
            return pd.DataFrame({"qid": qids[query], "chunk_ord": owner[best[query, column]], "score": kept[query, column]})

        of_block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block")
        # a list meets the blocks' terms and then their shards, both as small as the queries; it is shuffled once, to its group
        named = weights.select(of_block, F.col("term").alias("t")).distinct()

        def met(work: DataFrame) -> DataFrame:
            key = [*KEY, "block"]
            mine = work.join(weights, "qid").select(*KEY, of_block, "qid", "term", "w", "least")
            shards = work.select(*KEY, of_block).distinct().toDF("s", "h", "b")
            theirs = lists.join(named, F.col("term") == F.col("t")).join(shards, (F.col("segment") == F.col("s")) & (F.col("shard") == F.col("h")) & (F.col("block") == F.col("b")), "left_semi")
            theirs = theirs.select(F.col("segment").alias("segment"), F.col("shard").alias("shard"), F.col("block").alias("block"), F.col("term").alias("term"), "ords", "tfs", "dls")
            return mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInPandas(score, "qid long, chunk_ord long, score double")

        home = most.groupBy("qid").agg(F.max_by(F.struct(*KEY), F.struct("most", *KEY)).alias("home")).select("qid", "home.*")
        first = met(home.withColumn("least", F.lit(0.0))).persist()
        floors = first.groupBy("qid").agg(F.when(F.count("*") >= n, F.min("score") - SLACK).otherwise(F.lit(0.0)).alias("least"))
        other = most.join(home.select("qid", F.struct(*KEY).alias("home")), "qid").where(F.struct(*KEY) != F.col("home"))
        other = other.join(floors, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).where(F.col("most") + SLACK >= F.col("least"))
        hits = first.unionByName(met(other.select("qid", *KEY, "least")))
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_ord")
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).persist()
        # the first 2 n chunks hold n that a query with fewer hits doesn't have yet
        firsts = [r.chunk_ord for r in self._read("chunks").select("chunk_ord").orderBy("chunk_ord").limit(2 * n).collect()]
        short = queries.select(F.col("qid").cast("long").alias("qid")).join(best.groupBy("qid").agg(F.count("*").alias("has")), "qid", "left").where(F.coalesce("has", F.lit(0)) < n)
        fill = short.select("qid", F.explode(F.lit(firsts)).alias("chunk_ord")).join(best.select("qid", "chunk_ord"), ["qid", "chunk_ord"], "left_anti")
        every = best.select("qid", "chunk_ord", "score").unionByName(fill.withColumn("score", F.lit(0.0)))
        return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
