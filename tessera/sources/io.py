"""Readers and writers: text folders, judged examples, audit logs, keys, reports, tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import ship

EXAMPLE = "id string, query string, expected_citations array<string>, must_contain array<string>, must_not_contain array<string>, min_groundedness double"
AUDIT = "log_id string, seq bigint, event string, request_id string, actor string, details string, ts string, record_id string, prev_hash string, record_hash string"
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, doc_ord): each .txt file of a folder is a document named by its stem; doc_ord rises with the name.

    Names alone are sorted, over ranges; numbers have gaps between ranges. Texts stay where they are read until the join, by
    path, so that files of one name in several folders stay apart.
    """
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    # names come as parts of an address, in which a plus stands for itself
    name = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))), r"\.txt$", "")
    rows = rows.select(F.col("_metadata.file_path").alias("_path"), name.alias("doc_id"), F.col("value").alias("text"))
    order = rows.select("_path", "doc_id").orderBy("doc_id", "_path").withColumn("doc_ord", F.monotonically_increasing_id()).drop("doc_id")
    return rows.join(order, "_path").drop("_path")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Judged examples from JSON lines. Blank lines are skipped; id and query are required; lists default to empty and
    min_groundedness to 0.35."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", EXAMPLE, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"an example lacks {c}"))).otherwise(F.col(c)).cast("string").alias(c)
    none = F.expr("cast(array() as array<string>)")
    lists = [F.coalesce(c, none).alias(c) for c in ("expected_citations", "must_contain", "must_not_contain")]
    return rows.select(need("id"), need("query"), *lists, F.coalesce("min_groundedness", F.lit(0.35)).alias("min_groundedness"))


def write_examples(examples: DataFrame, path: str) -> None:
    """One JSON object for each line, keys in the order of EXAMPLE."""
    order = [c.split()[0] for c in EXAMPLE.split(", ")]
    examples.select(*order).write.mode("overwrite").json(path)


def append_audit(records: DataFrame, path: str) -> None:
    """Appends sealed records of any chains, with details of any type, to a log of JSON lines."""
    from ..operators.audit import line

    records.select(line(F.struct("*"), records.schema["details"].dataType, ("log_id", "seq"))).write.mode("append").text(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log; details are their JSON."""
    return spark.read.schema(AUDIT).json(path).select(*[c.split()[0] for c in AUDIT.split(", ")])


def read_heads(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """(log_id, head_seq, head_hash) behind the last batch of a log (before the given one); None for a log without any."""
    try:
        every = spark.read.parquet(f"{path}/heads")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = every if before is None else every.where(F.col("batch") < before)
    last = rows.agg(F.max("batch")).first()[0]
    return None if last is None else every.where(F.col("batch") == last).drop("batch")


def append_batch(records: DataFrame, path: str, batch: int) -> None:
    """Seals a batch of records behind all earlier batches of a log, and writes it and the heads of all chains behind it to
    folders of the batch. Repeating a batch replaces it by the same; one that failed is repeated before the next begins."""
    from ..operators.audit import heads, line, seal

    spark = records.sparkSession
    before = read_heads(spark, path, batch)
    sealed = seal(records, before)
    sealed.select(line(F.struct("*"), sealed.schema["details"].dataType, ("log_id", "seq"))).write.mode("overwrite").text(f"{path}/records/batch={batch}")
    after = heads(read_audit(spark, f"{path}/records/batch={batch}"))
    if before is not None:
        after = before.unionByName(after).groupBy("log_id").agg(F.max("head_seq").alias("head_seq"), F.max_by("head_hash", "head_seq").alias("head_hash"))
    after.write.mode("overwrite").parquet(f"{path}/heads/batch={batch}")


def write_audit_chain(records: DataFrame, path: str) -> None:
    """Writes one chain as lines of canonical JSON in order, as a log is kept elsewhere: files follow one another by name."""
    from ..operators.audit import line

    records.orderBy("seq").select(line(F.struct("*"), records.schema["details"].dataType)).write.text(path)


def read_audit_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, seq, record_id, prev_hash, record_hash, body) of logs of JSON lines, each file a chain in the order of its
    lines; body is what was hashed: the record without its hash, as JSON with sorted keys, no blanks and ASCII alone.
    Details may be of any JSON type. Blank lines are skipped."""
    ship(spark)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth"), F.trim("value").alias("line")).where("line <> ''")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [json.loads(x) for x in batch.column("line").to_pylist()]
            taken = [[str(r.get(c, "")) for r in records] for c in ("record_id", "prev_hash")]
            hashes = [str(r.pop("record_hash", "")) for r in records]
            bodies = [json.dumps(r, sort_keys=True, separators=(",", ":")) for r in records]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(x, pa.string()) for x in (*taken, hashes, bodies)]], ["log_id", "at", "nth", "record_id", "prev_hash", "record_hash", "body"])

    rows = lines.mapInArrow(parse, "log_id string, at long, nth long, record_id string, prev_hash string, record_hash string, body string")
    seq = F.row_number().over(Window.partitionBy("log_id").orderBy("at", "nth")).cast("long")
    return rows.select("log_id", seq.alias("seq"), "record_id", "prev_hash", "record_hash", "body")


def read_keys(spark: SparkSession, path: str | None, listed: str = "") -> DataFrame:
    """(api_key): those of a comma-separated list and those of a file's lines that don't begin with a hash sign, however
    many; the default key where there are none."""
    from ..operators.service import key_frame

    keys = [k.strip() for k in listed.split(",") if k.strip()]
    if not path:
        return key_frame(spark, keys)
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.trim("value").alias("api_key"))
    if keys:
        return lines.union(key_frame(spark, keys)).distinct()
    return lines.distinct() if not lines.isEmpty() else key_frame(spark, [])


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report or baseline: one JSON object over several lines."""
    return spark.read.option("multiLine", True).json(path)


def register_tables(spark: SparkSession, folder: str) -> None:
    """The driver's tables as views, for spark.sql."""
    for name in _TABLES:
        read_table(spark, folder, name).createOrReplaceTempView(name)


def add_documents(store: DataFrame | None, docs: DataFrame, chunker, **options) -> DataFrame:
    """The store's chunks and those of new documents, with doc_ord and, for chunkers that number chunks, chunk_ord, by which
    retrieval keeps them apart: adding an id again adds its chunks again, behind all others. Numbers follow the order in
    which documents are read, so write a store before it is searched."""
    from ..operators.index import numbered, with_order

    first = 0 if store is None else (store.agg(F.max("doc_ord")).first()[0] + 1 if not store.isEmpty() else 0)
    chunks = chunker(numbered(docs, first), **options)
    chunks = with_order(chunks if "idx" in chunks.columns else chunks.withColumn("idx", F.col("ord")))
    return chunks if store is None else store.unionByName(chunks, allowMissingColumns=True)
