"""Stages of the corpus pipeline: each applies one operator to all its predecessor kept and carries its decisions out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .minhash import near_duplicates
from .packing import pack
from .quality import quality_rules
from .secrets import redact, scan_secrets
from .tokens import token_counts
from .toxicity import toxicity

_OWN = "_column_of_documents_"


def _hidden(docs: DataFrame) -> DataFrame:
    """Documents under names that no operator's results have, whatever extra columns there are."""
    return docs.select(*[F.col(f"`{c}`").alias(_OWN + c) for c in docs.columns])


def _shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{_OWN}{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from the labelled ones among those that came in.

    A null text counts as empty; rows are judged each, so repeats go or stay together; null ids are judged like others;
    extra columns, whatever their names, are carried along; an empty table stays empty.
    """
    scored = toxicity(_hidden(docs), table(spark, sf_dir, "labels"), id_col=_OWN + "doc_id", text_col=_OWN + "text")
    return _shown(scored.where("predicted = 0"), docs)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and go; rows are judged each, null ids like others; extra columns, whatever their
    names, are carried along; an empty table stays empty.
    """
    judged = quality_rules(_hidden(docs), id_col=_OWN + "doc_id", text_col=_OWN + "text")
    return _shown(judged.where("kept"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id.

    Rows that share an id are near duplicates only if their texts are: one of those stays (ties fall to the smallest hash
    of the text, and among equal rows to any), all others stay. Rows without an id or without words stay. Extra columns,
    whatever their names, are carried along; an empty table stays empty.
    """
    hidden = _hidden(docs)
    scratch = Scratch(spark)
    judged = scratch.put(near_duplicates(hidden, id_col=_OWN + "doc_id", text_col=_OWN + "text"))
    # documents without words, or without an id, are in no group
    grouped = judged.where("n_shingles > 0 and doc_id is not null")
    first = F.min("text_key").alias("first_key")
    heads = scratch.put(grouped.where("kept").groupBy("doc_id", "group_key").agg(first, F.count("*").alias("rows")))
    chosen = heads.select(F.col("doc_id").alias("head_id"), F.col("first_key").alias("head_key")).distinct()
    gone = grouped.join(chosen, (F.col("doc_id") == F.col("head_id")) & (F.col("text_key") == F.col("head_key")), "left_anti")
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    key = F.xxhash64(F.coalesce(F.col(_OWN + "text"), F.lit("")))
    own = F.col(_OWN + "doc_id").cast("long")
    left = hidden.join(gone, (own == F.col("gone_id")) & (key == F.col("gone_key")), "left_anti")
    again = heads.where("rows > 1").select(F.col("doc_id").alias("head_id"), F.col("first_key").alias("head_key")).distinct()
    if not again.isEmpty():  # rows that repeat an id and a text: any of them
        same = (own == F.col("head_id")) & (key == F.col("head_key"))
        whole = F.struct(*hidden.columns)
        once = left.join(again, same, "left_semi").groupBy(own.alias("k"), key.alias("t")).agg(F.first(whole).alias("row")).select("row.*")
        left = left.join(again, same, "left_anti").unionByName(once)
    return _shown(left, docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind in brackets; n_chars follows the text.

    A null text stays null; rows are scanned each, null ids like others; extra columns, whatever their names, are carried
    along; an empty table stays empty.
    """
    hidden = _hidden(docs)
    found = scan_secrets(hidden, id_col=_OWN + "doc_id", text_col=_OWN + "text", keep=tuple(hidden.columns))
    rows = _shown(redact(found, _OWN + "text"), docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their bins, measured in the tokens of the counting operator and one end token.

    A null text is empty, one end token; rows are packed each, null ids like others; extra columns don't matter; an empty
    table gives no pieces.
    """
    return pack(token_counts(docs), length=F.col("n_tokens") + 1)
