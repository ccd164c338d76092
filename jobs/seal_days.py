"""Seals a service's events into tamper-evident audit chains, day by day, and counts them.

    python -m jobs.seal_days --source EVENTS --output LOG [--through 2024-01-31] [--config jobs/seal_days.json]

Each run takes the days behind the last one that is sealed, its high-water mark, up to `through`, which is the last day there
is if it isn't given: name the last day that is over, as events of a sealed day come too late and are left out, as are those
without a time. Chains go on from the heads that the last run left. In the output's folders:

    records/day=...     sealed records, in the order of seq by log
    counts/day=...      events and logs of a day by kind
    heads/through=...   the last place and hash of every chain, as of that day
    marks               the days through which all of the above is written

The mark is written last. A run that broke off is repeated from the mark before it: it takes the same days behind the same
heads, and replaces their folders by the same content.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.audit import details_json, heads, seal, verify

from .common import command_line, with_defaults

log = logging.getLogger("seal_days")

DEFAULTS = {"log": "user_id", "at": "ts", "order": "event_id", "event": "event_type", "values": ["value"], "json": ["props"], "actor": "service"}
RECORDS = "log_id string, seq bigint, event string, request_id string, actor string, details string, ts string, record_id string, prev_hash string, record_hash string, day date"
HEADS = "log_id string, head_seq bigint, head_hash string"


def _there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def records_of(events: DataFrame, before: DataFrame, settings: dict) -> DataFrame:
    """Audit records of events, numbered on from the heads of their logs; details are canonical JSON, hidden where they hint
    at a person. What isn't JSON where it should be is kept as text; a null log or event is an empty text."""
    at, order = F.col(settings["at"]), F.col(settings["order"])
    # times without a zone are taken as they stand, whatever the session's zone is
    local = events.schema[settings["at"]].dataType.typeName() == "timestamp_ntz"
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at) if local else F.unix_micros(at)
    details = F.struct(*settings["values"], *[F.coalesce(F.try_parse_json(c), F.col(c).cast("variant")).alias(c) for c in settings["json"]])
    kind = events.select(details.alias("d")).schema["d"].dataType
    # events are numbered as they come; what is made of them is made behind the shuffle, on as many tasks as that has
    rows = events.withColumn("_log", F.coalesce(F.col(settings["log"]).cast("string"), F.lit("")))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_log").orderBy(at, order)).cast("long"))
    rows = rows.join(before.select(F.col("log_id").alias("_of"), F.col("head_seq").alias("_head")), F.col("_log") == F.col("_of"), "left")
    rows = rows.withColumn("_micros", micros).select(
        F.col("_log").alias("log_id"),
        (F.coalesce("_head", F.lit(0)) + F.col("_place")).alias("seq"),
        F.coalesce(F.col(settings["event"]), F.lit("")).alias("event"),
        order.cast("string").alias("request_id"),
        F.lit(settings["actor"]).alias("actor"),
        details_json(details, kind, True).alias("details"),
        F.format_string("%d.%06d", F.expr("_micros div 1000000"), F.pmod("_micros", F.lit(1_000_000))).alias("ts"),
        F.to_date(at).alias("day"),
    )
    rows = rows.withColumn("record_id", F.substring(F.sha2(F.concat_ws(":", "log_id", "seq", "request_id"), 256), 1, 12))
    return rows.select("log_id", "seq", "event", "request_id", "actor", "details", "ts", "record_id", "day")


def run(spark: SparkSession, source: str, output: str, through: str | None = None, config: dict | None = None) -> DataFrame:
    """Seals the days of `source` (Parquet) behind the mark of `output`, up to `through`. Returns all sealed records."""
    settings = with_defaults(config, DEFAULTS)
    mark = _there(spark, f"{output}/marks", "through date").agg(F.max("through").cast("string")).first()[0]
    events = spark.read.parquet(source)
    at = F.col(settings["at"])
    if mark is not None:
        events = events.where(at >= F.date_add(F.lit(mark).cast("date"), 1))
    last = events.agg(F.max(F.to_date(at)).cast("string")).first()[0]
    through = min(through, last) if through and last else last
    stored = lambda: _there(spark, f"{output}/records", RECORDS)
    if through is None or (mark is not None and through <= mark):
        log.info("nothing behind %s in %s", mark, source)
        return stored()
    events = events.where(at < F.date_add(F.lit(through).cast("date"), 1))
    before = _there(spark, f"{output}/heads/through={mark}", HEADS) if mark else spark.createDataFrame([], HEADS)

    def put(rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{output}/{name}")

    put(seal(records_of(events, before, settings), before, ready=True), "records")
    new = stored().where(F.col("day") <= F.lit(through).cast("date"))
    new = new.where(F.col("day") > F.lit(mark).cast("date")) if mark else new
    broken = verify(new.drop("day"), before, ready=True).where("not ok").limit(10).collect()
    if broken:
        raise RuntimeError(f"chains that don't verify: {', '.join(f'{r.log_id} at {r.broken_at}' for r in broken)}")
    put(new.groupBy("day", "event").agg(F.count("*").alias("events"), F.countDistinct("log_id").alias("logs")), "counts")
    after = before.unionByName(heads(new)).groupBy("log_id").agg(F.max("head_seq").alias("head_seq"), F.max_by("head_hash", "head_seq").alias("head_hash"))
    after.write.mode("overwrite").parquet(f"{output}/heads/through={through}")
    spark.sql(f"SELECT DATE '{through}' AS through").coalesce(1).write.mode("append").parquet(f"{output}/marks")
    seen = new.agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"), F.countDistinct("log_id").alias("logs")).first()
    log.info("read %s behind %s: sealed %d events of %d logs and %d days through %s, in %s", source, mark, seen.n, seen.logs, seen.days, through, output)
    return stored()


if __name__ == "__main__":
    command_line("seal_days", run, {"source": "Parquet table of events", "output": "folder of the log"}, {"through": "last day to seal, as 2024-01-31"})
