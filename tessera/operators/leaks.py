"""Leaks across records: which answers hold an original of any request's redaction map."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..sources.session import ship

#: Originals of fewer characters are no leaks; of longer ones than HEAD bytes, the first HEAD bytes are looked up in texts.
LEAST, HEAD = 4, 48
#: Heads that are looked up in one pass over the texts; more are taken pass by pass. They are broadcast, 8 bytes each.
PASS = 2_000_000
#: Bytes of texts that are hashed at a time.
PIECE = 1 << 18
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64)
_POWER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses."""
    up = np.full(PIECE + 2 * HEAD, _POWER)
    down = np.full(PIECE + 2 * HEAD, np.uint64(pow(int(_POWER), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over bytes, from which the hash of any window follows."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers()[0][: len(data)])])


def _windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of a size; the same bytes have the same hash wherever they stand."""
    return (sums[size:] - sums[:-size]) * _powers()[1][: len(sums) - size]


def _hash(head: bytes) -> int:
    return int(_windows(_sums(np.frombuffer(head, np.uint8)), len(head))[0])


def _heads_in(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """(answer_id, head), each once for a row: what texts (answer_id, text: binary) hold of the heads (head: binary)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            values = np.array([_hash(h) for h in some], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([len(h) for h in some], pa.int32()), pa.array(values)], ["n", "h"])

    frame = heads.mapInArrow(hashed, "n int, h long").toPandas()
    known = {int(n): np.unique(g["h"].to_numpy().view(np.uint64)) for n, g in frame.groupby("n")}
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def places(data: np.ndarray, tables: dict[int, tuple[np.uint64, np.ndarray]]) -> Iterator[tuple[np.ndarray, int]]:
        for at in range(0, len(data), PIECE):
            sums = _sums(data[at : at + PIECE + HEAD - 1])
            for size, values in shared.value.items():
                if len(sums) > size:
                    windows, (shift, table) = _windows(sums, size)[:PIECE], tables[size]
                    some = np.nonzero(table[(windows >> shift).view(np.int64)])[0]
                    near = np.minimum(np.searchsorted(values, windows[some]), len(values) - 1)
                    yield some[values[near] == windows[some]] + at, size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for size, values in shared.value.items():
            bits = min(22, max(12, 4 + len(values).bit_length()))
            tables[size] = np.uint64(64 - bits), np.zeros(1 << bits, bool)
            tables[size][1][(values >> tables[size][0]).view(np.int64)] = True
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            if ends[-1] == ends[0]:
                continue
            data, ends, found = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0], set()
            for at, size in places(data, tables):
                row = np.searchsorted(ends, at, "right") - 1
                inside = at + size <= ends[row + 1]
                found.update((r, data[k : k + size].tobytes()) for r, k in zip(row[inside].tolist(), at[inside].tolist(), strict=True))
            if found:
                rows, held = zip(*sorted(found), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(held, pa.binary())], ["answer_id", "head"])

    return texts.mapInArrow(run, StructType([texts.schema["answer_id"], StructField("head", BinaryType())]))


def leaks_between(answers: DataFrame, originals: DataFrame) -> DataFrame:
    """(answer_id, original), each once, for all answers (answer_id, text) whose text holds an original (original) of four
    characters and more, whatever request either is of.

    The heads of originals are hashed and looked up among all windows of the texts' bytes that have the length of one; a task
    passes on only what is there, as bytes, which then meet the originals. So work follows the texts' length times the
    lengths that originals have (HEAD at most), and what is shuffled follows what leaks. Originals longer than their heads are
    confirmed on whole texts. A null text or original leaks nothing.
    """
    ship(answers.sparkSession)
    texts = answers.select("answer_id", "text").where("answer_id is not null and text is not null")
    data = texts.select("answer_id", F.col("text").cast("binary").alias("text"))
    wanted = originals.select("original").where(F.length("original") >= LEAST).distinct()
    head = F.substring(F.col("original").cast("binary"), 1, HEAD)
    # cached: the originals alone, as finding them may be the larger part of the work
    wanted = wanted.select("original", head.alias("head"), (F.octet_length("original") > HEAD).alias("long")).persist()
    out = texts.select("answer_id", F.lit("").alias("original")).limit(0)
    for r in wanted.groupBy("long").count().collect():
        some, passes = wanted.where(F.col("long") == r.long), -(-r["count"] // PASS)
        for k in range(passes):
            part = some.where(F.pmod(F.xxhash64("head"), F.lit(passes)) == k)
            met = _heads_in(data, part.select("head")).join(part, "head").select("answer_id", "original")
            out = out.unionByName(met.join(texts, "answer_id").where(F.contains("text", "original")).select("answer_id", "original") if r.long else met)
    return out.distinct()
