"""Sharding by balanced label propagation, with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def _by_ranges(position, ranges: list[tuple[int, int, int]], value):
    """CASE over a few half-open ranges (lo, hi, x): value(x, lo) where lo <= position < hi."""
    out = F.lit(None)
    for lo, hi, x in ranges:
        out = F.when((position >= lo) & (position < hi), value(x, lo)).otherwise(out)
    return out


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int = 3, slack: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of linked documents: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows.

    Documents with equal texts are linked. Each starts in a shard dealt by hash. In every round a join hands each linked
    document the shard that most of its group is in; documents that want to move are let through by quotas for each pair
    of shards: as many as come the other way, and the room that linked rows have under (1 - slack) times the mean, since
    unlinked rows make room later. Members of a group move as one, except for groups above a quarter of a shard. At last
    shards above their share give rows (unlinked ones first) to those below, so that row counts are at most one apart
    (law `rows`) and slots are gapless from 0.

    Texts are read once and never shuffled. A group of any share of all rows is spread by row: counts are partial
    aggregates, ranks are taken in small buckets with offsets from their counts, and only shards x shards counts reach
    the driver.

    Nulls: a null text counts as empty and a null doc_id is an id like any other. Repeated rows get a slot each. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = scratch.put(rows.withColumn("uid", F.monotonically_increasing_id()))
    total = rows.count()
    share = total / shards
    group = ["h", "text_crc32", "size"]
    groups = scratch.put(rows.groupBy(*group).agg(F.count("*").alias("group_rows")).where("group_rows > 1"))
    dealt = F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(shards)).cast("int")
    linked = scratch.put(rows.join(groups, group).withColumn("shard", dealt))
    for turn in range(rounds):
        loads = {r.shard: r.n for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        counts = linked.groupBy(*group, "shard").agg(F.count("*").alias("n"))
        wish = scratch.put(counts.groupBy(*group).agg(F.max(F.struct("n", F.xxhash64("h", "shard").alias("tie"), "shard")).getField("shard").alias("wish")))
        wishes = linked.join(wish, group)
        flow = {(r.shard, r.wish): r.n for r in wishes.where("shard <> wish").groupBy("shard", "wish").agg(F.count("*").alias("n")).collect()}
        if not flow:
            break
        ratio = F.lit(0.0)
        for (s, t), n in flow.items():
            back = min(n, flow.get((t, s), 0))
            into = sum(m - min(m, flow.get((t, x), 0)) for (x, y), m in flow.items() if y == t) or 1
            room = max(0.0, (1 - slack) * share - loads.get(t, 0))
            let = min(n, back + room * (n - back) / into)
            ratio = F.when((F.col("shard") == s) & (F.col("wish") == t), F.lit(let / n)).otherwise(ratio)
        draw = F.xxhash64(F.when(F.col("group_rows") > max(1.0, share / 4), F.col("uid")).otherwise(F.col("h")), F.lit(turn))
        goes = (F.pmod(draw, F.lit(1_000_000)) / 1_000_000) < ratio
        moved = scratch.put(wishes.withColumn("shard", F.when(goes, F.col("wish")).otherwise(F.col("shard"))).drop("wish"))
        scratch.drop(linked)
        scratch.drop(wish)
        linked = moved
    placed = linked.select("uid", "shard", "group_rows")
    everyone = rows.drop("h").join(placed, "uid", "left").select("doc_id", "size", "text_crc32", "uid", F.coalesce("shard", dealt).alias("shard"), F.coalesce("group_rows", F.lit(1)).alias("group_rows"))
    return _even(scratch, everyone, total, shards)


def _even(scratch: Scratch, rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Exactly even shards: each row's rank in its shard (unlinked rows first), by buckets; ranks below the surplus go."""
    buckets = max(64, math.isqrt(total))  # as many offsets to add up as rows to rank in each
    rows = scratch.put(rows.withColumn("part", F.when(F.col("group_rows") > 1, F.lit(buckets)).otherwise(F.lit(0)) + F.pmod(F.xxhash64("uid", F.lit(11)), F.lit(buckets))))
    scratch.keep(rows)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.put(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), "n"))
    loads = {r.shard: r.n for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    target = {s: total // shards + (s < total % shards) for s in range(shards)}
    gives, takes, given, taken = [], [], 0, 0
    for s in range(shards):
        extra = loads.get(s, 0) - target[s]
        if extra > 0:
            gives.append((s, extra, given))
            given += extra
        elif extra < 0:
            takes.append((taken, taken - extra, s))
            taken -= extra
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("uid")) - 1
    ranked = rows.join(counts.select("shard", "part", "offset"), ["shard", "part"]).withColumn("rank", rank)
    surplus, start = F.lit(0), F.lit(0)
    for s, extra, at in gives:
        surplus = F.when(F.col("shard") == s, F.lit(extra)).otherwise(surplus)
        start = F.when(F.col("shard") == s, F.lit(at)).otherwise(start)
    ranked = ranked.withColumn("surplus", surplus).withColumn("position", F.when(F.col("rank") < F.col("surplus"), F.col("rank") + start))
    position = F.col("position")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(position.isNull(), F.col("shard")).otherwise(_by_ranges(position, takes, lambda s, lo: F.lit(s))).cast("int").alias("shard"),
        F.when(position.isNull(), F.col("rank") - F.col("surplus")).otherwise(_by_ranges(position, takes, lambda s, lo: position - lo + loads.get(s, 0))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("group_rows").cast("long").alias("group_rows"),
    )
