"""Retrieval of chunks for queries (qid, query): BM25, hashed vectors, rank fusion, reranking. All queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.constants import RERANK_STOP
from ..functions.text import token_set, tokens
from ..sources.session import scratch_folder, ship
from .index import DIM, TILE, LexicalIndex, cell_matrix, hashed_cells
from .index import split_tokens as _split
from .postings import PostingIndex

K1, B, RRF = 1.5, 0.75, 60
#: Queries that are compared in one pass over the vectors; more are taken block by block.
QUERY_BLOCK = 2_000
#: Scores that a worker holds at a time: so many rows of a batch are scored together that queries x rows stays under it.
CELLS = 1 << 19
#: Pairs of a chunk's term and a query that asks for it which are laid out at a time.
PAIRS = 1 << 18
#: Bytes of chunks whose tokens a pass splits together, as each distinct one is hashed once: a worker holds about ten times that.
SCAN = 4 << 20
#: Terms that a sixteenth of the queries ask for meet all of them in a matrix product, so many at most.
WIDE = 512
#: Scores are compared after rounding, so that sums in another order don't break ties.
DIGITS = 9


_SCORED = "qid long, chunk_ord long, score double"


def _ranked(scored: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("ranking", "qid").orderBy(F.col("score").desc(), "chunk_ord")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """The queries in blocks of about QUERY_BLOCK."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for k in range(blocks):
        yield queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)


class Top:
    """The n best rows of each query, by (score, chunk_ord), of batches that come one after another. Scores are rounded before
    they are compared."""

    def __init__(self, asked: int, n: int):
        self.n, self.scores, self.ords = n, np.empty((asked, 0)), np.empty((asked, 0), np.int64)

    def add(self, ords: np.ndarray, scores: np.ndarray) -> None:
        """A batch's rows and their scores, queries x rows."""
        if not len(ords):
            return
        # once a query has its n, a batch matters to it only if a score reaches the last of them
        full = self.scores.shape[1] == self.n > 0
        some = np.flatnonzero(scores.max(axis=1) >= self.scores[:, -1] - 10.0**-DIGITS) if full else np.arange(len(scores))
        if not len(some):
            return
        order = np.argsort(ords, kind="stable")
        ords, scores = ords[order], np.round(scores[some][:, order], DIGITS) + 0.0
        keep = np.argsort(-scores, axis=1, kind="stable")[:, : self.n]
        both, owners = np.hstack([self.scores[some], np.take_along_axis(scores, keep, 1)]), np.hstack([self.ords[some], ords[keep]])
        order = np.lexsort((owners, -both), axis=1)[:, : self.n]
        both, owners = np.take_along_axis(both, order, 1), np.take_along_axis(owners, order, 1)
        if full:
            self.scores[some], self.ords[some] = both, owners
        else:
            self.scores, self.ords = both, owners


def _tile(asked: int, most: int = TILE) -> int:
    """Rows of a batch that are scored together."""
    return max(1, min(most, CELLS // max(1, asked)))


def _best(rows: DataFrame, score: Callable[[pd.DataFrame], np.ndarray], qids: np.ndarray, n: int, rankings: int = 1) -> DataFrame:
    """(ranking, qid, chunk_ord, score): the n best rows of each partition for each query, by (score, chunk_ord).

    score gives queries x rows for a batch of rows (chunk_ord, ...), as one block of arithmetic, or several rankings of the
    queries below each other; scores are rounded before they are compared. A partition keeps n candidates for each query
    and passes on no others, so that what is shuffled depends on partitions and queries and not on rows. Rows of score 0
    take part like all others.
    """

    asked = rankings * len(qids)
    size = _tile(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = Top(asked, n)
        for part in (batch.iloc[k : k + size] for batch in batches for k in range(0, len(batch), size)):
            top.add(part["chunk_ord"].to_numpy(), score(part))
        if top.scores.size:
            many = top.scores.shape[1]
            yield pd.DataFrame({"ranking": np.repeat(np.arange(rankings, dtype=np.int32), len(qids) * many), "qid": np.repeat(np.tile(qids, rankings), many), "chunk_ord": top.ords.ravel(), "score": top.scores.ravel()})

    return rows.mapInPandas(run, f"ranking int, {_SCORED}")


def _over_blocks(queries: DataFrame, columns: list, make: Callable[[pd.DataFrame], DataFrame], n: int) -> DataFrame:
    """The ranked union of what make returns for each block of queries, which is brought to the driver."""
    ship(queries.sparkSession)
    out = None
    for block in _blocks(queries):
        frame = block.select(F.col("qid").cast("long").alias("qid"), *columns).toPandas().sort_values("qid", kind="stable")
        if len(frame):
            found = make(frame)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], f"ranking int, {_SCORED}")
    return _ranked(out, n).drop("ranking")


def _text(c: str):
    return F.coalesce(c, F.lit("")).alias(c)


@dataclass
class Asked:
    """Terms of a block of queries: sorted terms, and for each the queries that ask for it and how often, in rows of at[k] to
    at[k + 1]. Its size is that of the queries' own text."""

    terms: pa.Array
    at: np.ndarray
    query: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, texts) -> Asked:
        flat, owner, _ = _split(texts)
        coded = flat.dictionary_encode()
        order = np.argsort(np.array(coded.dictionary.to_pylist(), object), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs, times = np.unique(place[coded.indices.to_numpy(zero_copy_only=False)] * len(texts) + owner, return_counts=True)
        at = np.searchsorted(pairs, np.arange(len(order) + 1) * len(texts))
        return cls(coded.dictionary.take(pa.array(order)), at, pairs % len(texts), times)

    def found(self, flat: pa.Array, owner: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens of texts: (text, term) pairs that occur, in order, and how often; and the number of tokens of each text."""
        coded, many = flat.dictionary_encode(), max(1, len(self.terms))
        known = pc.index_in(coded.dictionary, value_set=self.terms.cast(coded.dictionary.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        term = known[coded.indices.to_numpy(zero_copy_only=False)]
        pairs, tf = np.unique(owner[term >= 0] * many + term[term >= 0], return_counts=True)
        return pairs // many, pairs % many, tf, lengths


class Weights:
    """BM25 of a block of queries, from the terms of texts."""

    def __init__(self, asked: Asked, idf: np.ndarray, avgdl: float, queries: int):
        self.asked, self.idf, self.avgdl, self.queries = asked, idf, avgdl or 1.0, queries
        each = np.diff(asked.at)
        some = np.flatnonzero(16 * each >= queries)
        wide = some[np.argsort(-each[some], kind="stable")[:WIDE]]
        self.place, self.table = np.full(len(each), -1), np.zeros((len(wide), queries))
        self.place[wide] = np.arange(len(wide))
        for row, k in zip(self.table, wide, strict=True):
            row[asked.query[asked.at[k] : asked.at[k + 1]]] = asked.times[asked.at[k] : asked.at[k + 1]]

    def scores(self, chunk: np.ndarray, term: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """queries x texts, from what Asked.found gives."""
        asked = self.asked
        gain = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.maximum(1, lengths[chunk]) / self.avgdl))
        place = self.place[term]
        wide = place >= 0
        gains = np.zeros((len(lengths), len(self.table)))
        gains[chunk[wide], place[wide]] = gain[wide]
        out = (self.table.T @ gains.T).ravel()
        chunk, term, gain = chunk[~wide], term[~wide], gain[~wide]
        each = (asked.at[1:] - asked.at[:-1])[term]
        ends, hi = np.cumsum(each), 0
        # all others are laid out with the queries that ask for them, so many pairs at a time
        while hi < len(ends):
            lo, hi = hi, max(hi + 1, int(np.searchsorted(ends, (ends[hi - 1] if hi else 0) + PAIRS, "right")))
            n_each = each[lo:hi]
            first = np.repeat(asked.at[:-1][term[lo:hi]] - (np.cumsum(n_each) - n_each), n_each)
            at = first + np.arange(len(first))
            cell = asked.query[at] * len(lengths) + np.repeat(chunk[lo:hi], n_each)
            out += np.bincount(cell, weights=asked.times[at] * np.repeat(gain[lo:hi], n_each), minlength=len(out))
        return out.reshape(self.queries, len(lengths))


def _frequencies(rows: DataFrame, asked: Asked) -> tuple[np.ndarray, int, float]:
    """Document frequency of each asked term, number of chunks, and their mean length: one pass, counted in each batch, with
    sums alone passed on."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, total = np.zeros(len(shared.value.terms) + 1, np.int64), 0, 0
        for part in (batch.iloc[k : k + TILE] for batch in batches for k in range(0, len(batch), TILE)):
            _, term, _, lengths = shared.value.found(*_split(part["text"]))
            df += np.bincount(term, minlength=len(df))
            n, total = n + len(part), total + int(lengths.sum())
        some = np.nonzero(df)[0]
        yield pd.DataFrame({"k": np.append(some, [-1, -2]), "x": np.append(df[some], [n, total])})

    sums = {r.k: r.x for r in rows.select("text").mapInPandas(run, "k long, x long").groupBy("k").agg(F.sum("x").alias("x")).collect()}
    n, total = sums.pop(-1, 0), sums.pop(-2, 0)
    df = np.zeros(len(asked.terms), np.int64)
    df[list(sums)] = list(sums.values())
    return df, n, total / max(1, n)


def bm25_rank(queries: DataFrame, chunks: DataFrame, index: LexicalIndex | PostingIndex | None = None, n: int = 20) -> DataFrame:
    """(qid, chunk_ord, score, rank): the n best by BM25, ties by chunk order; chunks of score 0 fill a list up.

    A repeated query term counts repeatedly. The frequencies of the queries' own terms come from an index, or from a pass
    over the chunks that counts no others; a batch of chunks then gives all scores by a sparse product of its term
    weights with the queries'. An index kept in storage is searched by its postings instead, and the chunks aren't read.
    """
    if isinstance(index, PostingIndex):
        return index.rank(queries, n)
    rows = _rows(chunks)

    def make(frame: pd.DataFrame) -> DataFrame:
        score = _lexical(frame["query"], rows, index)
        return _best(rows, lambda batch: score(*_split(batch["text"])), frame["qid"].to_numpy(), n)

    return _over_blocks(queries, [_text("query")], make, n)


def _rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_ord").cast("long").alias("chunk_ord"), _text("text"))


def _idf(df: np.ndarray, total: int) -> np.ndarray:
    return np.where(df > 0, np.log(1 + (total - df + 0.5) / (df + 0.5)), 0.0)


def _indexed(asked: Asked, index: LexicalIndex) -> tuple[np.ndarray, float]:
    """What an index has of the asked terms: idf; and its mean length of chunks."""
    terms = asked.terms.to_pylist()
    wanted = index.dictionary.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    known = {r.term: r.idf for r in index.dictionary.join(F.broadcast(wanted), "term", "left_semi").select("term", "idf").collect()}
    return np.array([known.get(t, 0.0) for t in terms]), index.stats.first().avgdl


def _lexical(texts: pd.Series, rows: DataFrame, index: LexicalIndex | None) -> Callable[..., np.ndarray]:
    """BM25 of a block of queries: queries x texts, from the tokens of texts."""
    asked = Asked.of(texts)
    if index is None:
        df, total, avgdl = _frequencies(rows, asked)
        idf = _idf(df, total)
    else:
        idf, avgdl = _indexed(asked, index)
    shared = rows.sparkSession.sparkContext.broadcast(Weights(asked, idf, avgdl, len(texts)))
    return lambda *split: shared.value.scores(*shared.value.asked.found(*split))


def vector_rank(queries: DataFrame, vectors: DataFrame, n: int = 20) -> DataFrame:
    """(qid, chunk_ord, score, rank): the n best of vectors (chunk_ord, v) by cosine to queries (qid, v), all compared."""
    rows = vectors.select(F.col("chunk_ord").cast("long").alias("chunk_ord"), F.col("v").cast("array<double>").alias("v"))

    def make(frame: pd.DataFrame) -> DataFrame:
        shared = queries.sparkSession.sparkContext.broadcast(_unit(np.array(frame["v"].tolist(), np.float64)))
        return _best(rows, lambda batch: shared.value @ _unit(np.array(batch["v"].tolist(), np.float64)).T, frame["qid"].to_numpy(), n)

    return _over_blocks(queries, [F.col("v").cast("array<double>").alias("v")], make, n)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm == 0, 1.0, norm)[:, None]


def _hashed(texts) -> np.ndarray:
    """Vectors of texts, as index.hashed_vectors has them but for their length."""
    flat, owner, lengths = _split(texts)
    return cell_matrix(*hashed_cells(flat, owner), len(lengths))


def _dense(texts: list[str], rows: DataFrame, embed: Callable) -> Callable[..., np.ndarray]:
    """Cosines of a block of queries: queries x texts, from the texts, or from their tokens' cells where texts are hashed."""
    shared, plain = rows.sparkSession.sparkContext.broadcast(_unit(np.asarray(embed(texts), np.float64))), embed is _hashed

    def score(texts: pd.Series | pa.Array, cells: tuple | None = None) -> np.ndarray:
        made = cell_matrix(*cells, len(texts)) if cells else _hashed(texts) if plain else np.asarray(embed(texts.tolist()), np.float64)
        return shared.value @ _unit(made).T

    return score


def dense_rank(queries: DataFrame, chunks: DataFrame, n: int = 20, embed: Callable = _hashed) -> DataFrame:
    """As vector_rank, over vectors of the texts, which are made batch by batch and never written or shuffled. embed gives
    the rows of a matrix for a list of texts; by default they are hashed."""
    rows = _rows(chunks)

    def make(frame: pd.DataFrame) -> DataFrame:
        score = _dense(frame["query"].tolist(), rows, embed)
        return _best(rows, lambda batch: score(batch["text"]), frame["qid"].to_numpy(), n)

    return _over_blocks(queries, [_text("query")], make, n)


def fuse(dense: DataFrame, bm25: DataFrame, n: int = 20, k: int = RRF) -> DataFrame:
    """(qid, chunk_ord, fused, fused_rank): reciprocal ranks summed; ties by the dense rank, then by the other."""
    a = dense.select("qid", "chunk_ord", F.col("rank").alias("dense_rank"))
    b = bm25.select("qid", "chunk_ord", F.col("rank").alias("bm25_rank"))
    return _fused(a.join(b, ["qid", "chunk_ord"], "full_outer"), n, k)


def _fused(both: DataFrame, n: int, k: int = RRF) -> DataFrame:
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = both.withColumn("fused", part("dense_rank") + part("bm25_rank"))
    order = Window.partitionBy("qid").orderBy(F.col("fused").desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last())
    return both.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= n).select("qid", "chunk_ord", "fused", "fused_rank")


def overlap_score(own: Column, text: Column) -> Column:
    """The share of a query's tokens that a text has."""
    return F.size(F.array_intersect(own, tokens(text))) / F.greatest(F.size(own), F.lit(1))


def rerank(queries: DataFrame, candidates: DataFrame, chunks: DataFrame, top_k: int = 5, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(qid, chunk_ord, chunk_id, doc_id, text, score, rank, source): the top_k by the share of the query's tokens that a
    candidate has, or by a score of one's own of the columns (query, text); ties by fused rank."""
    texts = candidates.join(chunks.select("chunk_ord", "chunk_id", "doc_id", "text"), "chunk_ord")
    query = F.coalesce("query", F.lit(""))
    pairs = texts.join(queries.select("qid", query.alias("_query"), token_set(query, RERANK_STOP).alias("own")), "qid")
    scored = pairs.withColumn("score", (score(F.col("_query"), F.col("text")) if score else overlap_score(F.col("own"), F.col("text"))).cast("double"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "fused_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("qid", "chunk_ord", "chunk_id", "doc_id", "text", "score", "rank", F.lit("reranked").alias("source"))


#: What a pass over chunks leaves: a chunk and its terms, a candidate by vectors, frequencies of terms.
CHUNK, NEAR, COUNTS = 0, 1, 2


def _gathered(batches: Iterator[pa.RecordBatch], name: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until a column has so many bytes."""
    held, total = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            total += batch.column(name).nbytes
        if total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _scanned(chunks: DataFrame, asked: Asked, dense: Callable, plain: bool, qids: np.ndarray, n: int, texts: bool) -> DataFrame:
    """One pass over the chunks for a block of queries, written to scratch: each chunk (with its text, if that is wanted), its
    length, and those of its terms that are asked for, by their places, and how often each occurs; of each partition, the n
    best chunks of each query by vectors, and how many chunks have each term; places behind the last term count chunks and
    tokens."""
    spark = chunks.sparkSession
    kind_of = chunks.schema
    schema = StructType([*StructType.fromDDL("kind int").fields, *[StructField(c, kind_of[c].dataType) for c in ("chunk_id", "doc_id", "text")], *StructType.fromDDL(f"{_SCORED}, dl int, terms array<int>, times array<bigint>").fields])
    shared, size, many = spark.sparkContext.broadcast(asked), _tile(len(qids), 4 * TILE), len(asked.terms)
    lists = lambda ends, x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, counts, like = Top(len(qids), n), np.zeros(many + 2, np.int64), None

        def made(kind: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
            columns["kind"] = pa.array(np.full(rows, kind, np.int32))
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in like], schema=like)

        for batch in _gathered(batches, "text", SCAN):
            if like is None:
                own = [pa.field("kind", pa.int32()), *[batch.schema.field(c) for c in ("chunk_id", "doc_id", "text")]]
                own += [pa.field("qid", pa.int64()), pa.field("chunk_ord", pa.int64()), pa.field("score", pa.float64()), pa.field("dl", pa.int32())]
                own += [pa.field("terms", pa.list_(pa.int32())), pa.field("times", pa.list_(pa.int64()))]
                like = pa.schema([f.with_nullable(True) for f in own])
            text, ords = batch.column("text").fill_null(""), batch.column("chunk_ord").to_numpy(zero_copy_only=False)
            flat, owner, lengths = _split(text)
            coded = flat.dictionary_encode()
            cells = hashed_cells(coded, owner) if plain else None
            for k in range(0, len(text), size):
                at = slice(*np.searchsorted(owner, [k, k + size]))
                top.add(ords[k : k + size], dense(text.slice(k, size), tuple(c[at] - k * DIM for c in cells) if plain else None))
            chunk, term, tf, _ = shared.value.found(coded, owner, lengths)
            counts[:many] += np.bincount(term, minlength=many)
            counts[many:] += len(text), lengths.sum()
            ends = np.searchsorted(chunk, np.arange(len(text) + 1))
            kept = {c: batch.column(c) for c in ("chunk_ord", "chunk_id", "doc_id", *["text"] * texts)}
            yield made(CHUNK, len(text), dl=pa.array(lengths, pa.int32()), terms=lists(ends, term, pa.int32()), times=lists(ends, tf, pa.int64()), **kept)
        if like is not None:
            yield made(NEAR, top.scores.size, qid=pa.array(np.repeat(qids, top.scores.shape[1])), chunk_ord=pa.array(top.ords.ravel()).cast(pa.int64()), score=pa.array(top.scores.ravel()))
            some = np.flatnonzero(counts)
            yield made(COUNTS, 1, terms=lists([0, len(some)], some, pa.int32()), times=lists([0, len(some)], counts[some], pa.int64()))

    folder = scratch_folder(spark, "scan")
    chunks.select(F.col("chunk_ord").cast("long").alias("chunk_ord"), "chunk_id", "doc_id", "text").mapInArrow(run, schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _listed(shared) -> Callable[[pd.DataFrame], np.ndarray]:
    """BM25 of chunks from their terms, as a pass over them left these."""

    def score(batch: pd.DataFrame) -> np.ndarray:
        chunk = np.repeat(np.arange(len(batch)), batch["terms"].map(len).to_numpy(np.int64))
        return shared.value.scores(chunk, np.concatenate(batch["terms"].tolist()).astype(np.int64), np.concatenate(batch["times"].tolist()), batch["dl"].to_numpy(np.int64))

    return score


def hybrid(queries: DataFrame, chunks: DataFrame, index: LexicalIndex | PostingIndex | None = None, top_k: int = 5, prefetch: int = 20, embed: Callable = _hashed, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The top_k of the fused rankings by vectors and by BM25, reranked; embed and score as in dense_rank and rerank.

    One pass over the chunks makes them, splits their tokens once, ranks them by vectors and writes them to scratch with those
    of their terms that are asked for. BM25 is ranked from these, once their frequencies are known, and candidates' texts are
    looked up there: the candidates are broadcast (QUERY_BLOCK x prefetch at most), and no texts are shuffled but theirs. Of
    several blocks of queries, the others' passes read the chunks that the first has written.
    """
    ship(queries.sparkSession)
    spark, stored, out = queries.sparkSession, None, None
    for block in _blocks(queries):
        frame = block.select(F.col("qid").cast("long").alias("qid"), _text("query")).toPandas().sort_values("qid", kind="stable")
        if not len(frame) and out is not None:
            continue
        asked = spark.createDataFrame([(int(q), t) for q, t in zip(frame["qid"], frame["query"], strict=True)], "qid long, query string")
        if isinstance(index, PostingIndex) or not len(frame):
            candidates = fuse(dense_rank(asked, chunks, prefetch, embed), bm25_rank(asked, chunks, index, prefetch), prefetch)
        else:
            qids, terms = frame["qid"].to_numpy(), Asked.of(frame["query"])
            scan = _scanned(chunks if stored is None else stored, terms, _dense(frame["query"].tolist(), chunks, embed), embed is _hashed, qids, prefetch, stored is None)
            if stored is None:
                stored = scan.where(F.col("kind") == CHUNK).select("chunk_ord", "chunk_id", "doc_id", "text")
            if index is None:
                pairs = scan.where(F.col("kind") == COUNTS).select(F.explode(F.arrays_zip("terms", "times")).alias("p"))
                counts = np.zeros(len(terms.terms) + 2, np.int64)
                for r in pairs.groupBy("p.terms").agg(F.sum("p.times").alias("n")).collect():
                    counts[r.terms] = r.n
                idf, avgdl = _idf(counts[:-2], counts[-2]), counts[-1] / max(1, counts[-2])
            else:
                idf, avgdl = _indexed(terms, index)
            shared = spark.sparkContext.broadcast(Weights(terms, idf, avgdl, len(frame)))
            lexical = _best(scan.where(F.col("kind") == CHUNK).select("chunk_ord", "dl", "terms", "times"), _listed(shared), qids, prefetch)
            near = scan.where(F.col("kind") == NEAR).select(F.lit(1).alias("ranking"), "qid", "chunk_ord", "score")
            ranked = _ranked(near.unionByName(lexical), prefetch)
            of = lambda k, name: F.max(F.when(F.col("ranking") == k, F.col("rank"))).alias(name)
            candidates = _fused(ranked.groupBy("qid", "chunk_ord").agg(of(1, "dense_rank"), of(0, "bm25_rank")), prefetch)
        found = rerank(F.broadcast(asked), F.broadcast(candidates), chunks if stored is None else stored, top_k, score)
        out = found if out is None else out.unionByName(found)
    return out


def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The first chunk of an id."""
    return chunks.where(F.col("chunk_id") == chunk_id).orderBy("chunk_ord").limit(1)
