"""Indexes over chunks (chunk_ord, chunk_id, doc_id, text): postings, lengths, dictionary, hashed vectors.

chunk_ord is a unique long that gives the order of insertion, by which ties are broken everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from ..functions.arrays import exploded, let
from ..functions.text import tokens
from ..sources.session import ship

DIM = 384
#: Rows of a batch whose tokens a worker holds at a time.
TILE = 128
#: Bytes of UTF-8 in lower case, with a blank for each that is in no token (functions.text.TOKEN).
_IN_TOKEN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))


#: Chunks that a document may have in a chunk_ord; documents are numbered up to 2**43.
PER_DOC = 1 << 20


def _bytes(rows: pa.LargeStringArray) -> bytes:
    """The UTF-8 of all texts, without a gap between them."""
    _, offsets, data = rows.buffers()
    if not len(rows) or data is None:
        return b""
    ends = np.frombuffer(offsets, np.int64)
    lo, hi = int(ends[rows.offset]), int(ends[rows.offset + len(rows)])
    return data.slice(lo, hi - lo).to_pybytes()


def split_tokens(texts: Iterable[str] | pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens of several texts one after another, the text each belongs to, and how many each text has."""
    rows = (texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.large_string())).cast(pa.large_string())
    data = _bytes(rows)
    # of all characters beyond ASCII, these two alone have a letter of ASCII in their lower case
    if b"\xc4\xb0" in data or b"\xe2\x84\xaa" in data:
        rows = pa.array([t.lower() for t in rows.to_pylist()], pa.large_string())
        data = _bytes(rows)
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, np.int64)
    bare = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data.translate(_IN_TOKEN)))
    parts = pc.ascii_split_whitespace(bare)
    flat = parts.flatten()
    owner = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(flat), 0)
    owner = owner[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full), owner, np.bincount(owner, minlength=len(parts))


def numbered(docs: DataFrame, first: int = 0) -> DataFrame:
    """The documents with doc_ord: their places in the table, from `first` on, without gaps. Ids may be of any type, may
    repeat and may be null. Rows are counted for each partition, and only those counts reach the driver."""
    rows = docs.withColumn("_m", F.monotonically_increasing_id())
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, at = [], first
    for p, n in counts:
        starts.append((p, at))
        at += n
    offsets = docs.sparkSession.createDataFrame(starts, "_p long, _start long")
    # one row for each partition
    return rows.join(F.broadcast(offsets), part == F.col("_p")).withColumn("doc_ord", F.col("_start") + place).drop("_m", "_p", "_start")


def with_order(chunks: DataFrame) -> DataFrame:
    """chunk_ord from the document's number and the chunk's place in it, without a shuffle. The number is doc_ord (see
    `numbered`) where there is one, and else a doc_id that is a number, unique and not null."""
    if "doc_ord" in chunks.columns:
        base = F.col("doc_ord")
    elif isinstance(chunks.schema["doc_id"].dataType, NumericType):
        base = F.col("doc_id")
    else:
        raise ValueError("documents whose ids are no numbers need a doc_ord: see numbered()")
    number = base.cast("long") * PER_DOC + F.col("idx")
    outside = (F.col("idx") >= PER_DOC) | (base >= 1 << 43) | (base < 0)
    return chunks.withColumn("chunk_ord", F.when(outside, F.raise_error(F.lit("a document has too many chunks, or too high a number, for a chunk_ord"))).otherwise(number))


@dataclass
class LexicalIndex:
    """postings (term, chunk_ord, tf, dl), dictionary (term, df, idf), stats (n, avgdl; one row)."""

    postings: DataFrame
    dictionary: DataFrame
    stats: DataFrame


def postings_of(chunks: DataFrame) -> DataFrame:
    """(term, chunk_ord, tf, dl). Counting happens within a chunk's row, so no shuffle is needed."""
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, TILE) for b in batches for k in range(0, b.num_rows, TILE)):
            flat, owner, lengths = split_tokens(batch.column(1).to_pylist())
            coded = flat.dictionary_encode()
            many = max(1, len(coded.dictionary))
            pairs, tf = np.unique(owner * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = pairs // many
            columns = [coded.dictionary.take(pa.array(pairs % many)).cast(pa.string()), batch.column(0).take(pa.array(row)), pa.array(tf, pa.int64()), pa.array(lengths[row], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "chunk_ord", "tf", "dl"])

    rows = chunks.select("chunk_ord", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.mapInArrow(run, StructType([*StructType.fromDDL("term string").fields, rows.schema["chunk_ord"], *StructType.fromDDL("tf long, dl int").fields]))


def lexical_index(chunks: DataFrame) -> LexicalIndex:
    postings = postings_of(chunks)
    stats = chunks.select(F.size(tokens(F.coalesce("text", F.lit("")))).alias("dl")).agg(F.count("*").alias("n"), (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))
    # a term counts once for a chunk, so no posting has to be made for its frequency
    df = exploded(chunks, [], F.array_distinct(tokens(F.coalesce("text", F.lit("")))), "term").groupBy("term").agg(F.count("*").alias("df"))
    # one row: the statistics of the corpus
    dictionary = df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return LexicalIndex(postings, dictionary, stats)


def buckets_of(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two buckets of each token: its sha256, read as a number, modulo DIM; and the same without its last 16 bits."""
    words = tokens.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    digests = np.frombuffer(b"".join([sha256(w).digest() for w in words]), np.uint8).reshape(-1, 32)
    # DIM is 3 * 128: a byte's place doesn't matter modulo 3, and modulo 128 only the last byte does
    low = lambda d: d[:, -1].astype(np.int64) & 127
    bucket = lambda d: low(d) + 128 * (2 * (d.sum(1, dtype=np.int64) - low(d)) % 3)
    return bucket(digests), bucket(digests[:, :30])


def hashed_cells(flat: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """text * DIM + bucket for both buckets of every token. Each distinct token of a batch is hashed once."""
    coded = flat.dictionary_encode()
    place, base = coded.indices.to_numpy(zero_copy_only=False), owner * DIM
    first, second = buckets_of(coded.dictionary)
    return base + first[place], base + second[place]


def cell_matrix(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """What hashed_counts gives, as rows of n texts, from their tokens' cells."""
    return (np.bincount(first, minlength=n * DIM) + 0.5 * np.bincount(second, minlength=n * DIM)).reshape(-1, DIM)


def hashed_counts(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight), in order: every token adds 1 to one bucket and 0.5 to another."""
    flat, owner, _ = split_tokens(texts)
    cells, place = np.unique(np.concatenate(hashed_cells(flat, owner)), return_inverse=True)
    return cells // DIM, cells % DIM, np.bincount(place, weights=np.repeat([1.0, 0.5], len(owner)), minlength=len(cells))


def hashed_weights(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sparse unit vectors (key, bucket, w): every token adds 1 to one bucket and 0.5 to another; then the norm is 1. A row is
    counted within itself, and only its sums (DIM at most) are shuffled, as rows may share a key."""
    ship(rows.sparkSession)
    schema = StructType([rows.schema[key], *StructType.fromDDL("v array<struct<bucket:int,w:double>>").fields])
    entries = pa.struct([("bucket", pa.int32()), ("w", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, TILE) for b in batches for k in range(0, b.num_rows, TILE)):
            owner, bucket, w = hashed_counts(batch.column(1).to_pylist())
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(bucket, pa.int32()), pa.array(w, pa.float64())], fields=list(entries))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], [key, "v"])

    counted = rows.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("t")).mapInArrow(run, schema)
    lists = counted.groupBy(key).agg(F.collect_list("v").alias("vs"))  # one for each row of a key

    def summed(vs: Column) -> Column:
        add = lambda m, x: F.map_zip_with(m, F.map_from_entries(x), lambda k, p, q: F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0)))
        entries = F.map_entries(F.aggregate(F.slice(vs, 2, F.size(vs)), F.map_from_entries(F.get(vs, 0)), add))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("bucket"), e["value"].alias("w")))

    merged = F.when(F.size("vs") == 1, F.get("vs", 0)).otherwise(summed(F.col("vs")))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    unit = let(merged, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.struct(x["bucket"].alias("bucket"), (x["w"] / n).alias("w")))))
    return exploded(lists, [key], unit, "p").select(key, "p.bucket", "p.w")


def hashed_vectors(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Dense form (key, v: array of DIM doubles); rows without tokens get zeros."""
    sparse = hashed_weights(rows, key, text).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    zero = F.array_repeat(F.lit(0.0), DIM)
    return rows.select(key).join(sparse, key, "left").select(key, F.when(F.col("m").isNull(), zero).otherwise(dense).alias("v"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size)


def store_stats(chunks: DataFrame) -> DataFrame:
    """documents, chunks."""
    return chunks.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"))
