"""Shared plumbing of the training-data operators: scratch tables on shared storage and text helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import ship

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a local one where none is set and all runs in
    one process (tests). On a cluster a folder of each machine would lose tables, so there it has to be set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{os.path.join(tempfile.gettempdir(), 'tessera-checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def trim() -> None:
    """Gives freed memory of this worker back, which else stays with it while it waits for the next task."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """A function over batches that trims its worker once a partition is done."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


class Scratch:
    """Tables written as Parquet to the shared folder: they cut lineage, survive lost executors, and are read back
    with fresh partitioning, so that a skewed join over them can be split at run time.

    `put` writes a table and returns it as read back; `drop` and `keep` remove what is no longer needed. What is left goes
    when the process ends, because a returned DataFrame may still read it.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self._count, self._paths = 0, set()
        atexit.register(self.clear)

    def put(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self._paths.add(path)
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df.scratch_path)
        self._paths.discard(df.scratch_path)

    def keep(self, *frames: DataFrame) -> None:
        """Drops all tables but these, which a result is still read from."""
        for path in self._paths - {f.scratch_path for f in frames}:
            self._delete(path)
        self._paths = {f.scratch_path for f in frames}

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may have gone already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def slices(items: list, weight, most: int):
    """Consecutive slices of items whose weights sum to `most` or less, or that hold a single item."""
    start, total = 0, 0
    for i, item in enumerate(items):
        w = weight(item)
        if i > start and total + w > most:
            yield start, i
            start, total = i, 0
        total += w
    if start < len(items):
        yield start, len(items)


#: Words of 64 bits in the bitmap of may_be_among: 2 MB of bits whatever it is made of.
WORDS = 1 << 18


def may_be_among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among the wanted ones (a single column), and some others: a filter before a join.

    Keys are hashed to a bitmap of fixed size, which is all that is broadcast. Few rows pass in vain while the bitmap is
    sparse; beyond that it lets more through, and the join behind it does the work.
    """
    (name,) = wanted.columns
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(WORDS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{c}`), 58) as int))")
    bitmap = wanted.select(word(name).alias("_word"), bit(name).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    # at most WORDS rows of two longs
    return rows.join(F.broadcast(bitmap), word(key) == F.col("_word")).where(F.col("_bits").bitwiseAND(bit(key)) != 0).select(*rows.columns)
