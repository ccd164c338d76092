"""Variable-capacity best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

CAPACITIES = (512, 1024, 2048, 4096)
#: Rows of a plan (of nine numbers each) up to which it is handed to every worker.
SMALL_PLAN = 200_000


class Plan:
    """runs: (length, lo, hi, bin_lo, per_bin, at): the lo-th to (hi-1)-th pieces of a length go per_bin to a bin, from
    bin_lo on, the first of them at offset `at`. bins: (lo, hi, opened, capacity, used) for ranges of equal bins, in
    order and without gaps."""

    def __init__(self):
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.bins: list[tuple[int, int, int, int, int]] = []


def _fill(capacity: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """How many pieces of each length a greedy best fit puts into a bin of this capacity."""
    room, hi, used = capacity, len(lengths), {}
    while room and hi:
        i = bisect_left(lengths, room + 1, 0, hi) - 1
        if i < 0:
            break
        n = min(left[lengths[i]], room // lengths[i])
        if n:
            used[lengths[i]] = n
            room -= lengths[i] * n
        hi = i
    return used


def plan_bins(histogram: dict[int, int], capacities=CAPACITIES, bin_cost: int = 32) -> Plan:
    """Best-fit decreasing over (length: how many), for all pieces of a length at once.

    A piece goes to the open bin with the least sufficient room. Where none has room, the bin size is opened whose cost
    (capacity + bin_cost) per token that the remaining lengths can fill it with is least; of that size, as many bins as
    can be filled alike, and then the sizes are weighed anew on the pieces that no opened bin is expected to take. Once
    all are placed, every bin shrinks to the least permitted capacity that holds its contents. The work and the plan
    depend on the number of different lengths and not on how many pieces there are.
    """
    sizes = sorted(capacities)
    lengths = sorted(n for n, c in histogram.items() if c)
    if lengths and (lengths[0] < 1 or lengths[-1] > sizes[-1]):
        raise ValueError("lengths must lie between 1 and the largest capacity")
    left = {n: histogram[n] for n in lengths}
    spare = dict(left)  # pieces that no opened bin is expected to take
    free = list(lengths)  # the lengths of those, ascending
    plan, opened = Plan(), 0
    rooms: list[int] = []  # the different rooms of open bins, ascending
    groups: dict[int, list[list[int]]] = {}  # room: [lo, hi, capacity] ranges of equal bins

    def put_back(room: int, lo: int, hi: int, capacity: int) -> None:
        if hi > lo:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append([lo, hi, capacity])

    for length in reversed(lengths):
        placed = 0
        while left[length]:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                lo, hi, capacity = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                spare[length] = max(1, spare[length])
                if not free or free[-1] != length:
                    free.append(length)
                fills = {c: _fill(c, free, spare) for c in sizes if c >= length}
                capacity = min(fills, key=lambda c: ((c + bin_cost) / sum(n * k for n, k in fills[c].items()), c))
                alike = min(spare[n] // k for n, k in fills[capacity].items())
                alike = min(alike, -(-left[length] // (capacity // length)))
                for n, k in fills[capacity].items():
                    spare[n] -= alike * k
                free = [n for n in free if spare[n]]
                lo, hi, room = opened, opened + alike, capacity
                opened = hi
            each = room // length
            full = min(hi - lo, left[length] // each)
            rest = 0 if full == hi - lo else left[length] - full * each
            for n, start, stop in ((each, lo, lo + full), (rest, lo + full, lo + full + bool(rest))):
                if stop > start and n:
                    pieces = n * (stop - start)
                    plan.runs.append((length, placed, placed + pieces, start, n, capacity - room))
                    placed += pieces
                    left[length] -= pieces
                    put_back(room - n * length, start, stop, capacity)
            put_back(room, lo + full + bool(rest), hi, capacity)
        spare[length] = 0
        if free and free[-1] == length:
            free.pop()
    for room, ranges in groups.items():
        for lo, hi, capacity in ranges:
            used = capacity - room
            plan.bins.append((lo, hi, capacity, next(c for c in sizes if c >= used), used))
    plan.bins.sort()
    return plan


def cut_runs(plan: Plan) -> list[tuple[int, int, int, int, int, int, int, int, int]]:
    """The runs, cut where the bins they fill end up different: (length, lo, hi, bin_lo, per_bin, at, opened, capacity, used)."""
    starts, out = [b[0] for b in plan.bins], []
    for length, lo, hi, bin_lo, per_bin, at in plan.runs:
        while lo < hi:
            _, end, opened, capacity, used = plan.bins[bisect_right(starts, bin_lo) - 1]
            stop = min(hi, lo + (end - bin_lo) * per_bin)
            out.append((length, lo, stop, bin_lo, per_bin, at, opened, capacity, used))
            lo, bin_lo = stop, end
    return out


def word_tokens(text):
    """Words and one end token."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))) + 1


def pack(docs: DataFrame, capacities=CAPACITIES, bin_cost: int = 32, id_col: str = "doc_id", text_col: str = "text", length=None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, bin_id, bin_offset, capacity, opened_capacity, bin_used.

    length: a column of token counts (words and one end token, if not given). Documents longer than the largest capacity
    are cut into pieces of that capacity and a rest; start is the piece's first token. Only the counts of each length
    (as many as the largest capacity at most) reach the driver, and the plan that goes back is bounded likewise. Ranks
    within a length are taken in small buckets with offsets, so a length that a third of all pieces have is spread.

    Nulls: a null text is empty, one end token. A row whose given length is null or below 1 has no piece. A null doc_id is an
    id like any other. Repeated rows are packed each. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    most = max(capacities)
    tokens = length if length is not None else word_tokens(F.coalesce(docs[text_col], F.lit("")))
    rows = docs.select(docs[id_col].alias("doc_id"), tokens.cast("long").alias("tokens")).where("tokens > 0")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / most).cast("int"))))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * most).alias("start"), F.least(F.lit(most), F.col("tokens") - F.col("piece").cast("long") * most).cast("int").alias("length"))
    pieces = scratch.put(pieces.withColumn("uid", F.monotonically_increasing_id()))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_bins(histogram, capacities, bin_cost)

    total = sum(histogram.values())
    buckets = max(64, math.isqrt(total))  # as many offsets to add up as rows to rank in each
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("length", "part").orderBy("uid")) - 1
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", rank)

    # As many rows as different lengths and bins need, whatever the input; the join is broadcast only where that is small.
    runs = cut_runs(plan)
    frame = spark.createDataFrame(runs, "run_length int, lo long, hi long, bin_lo long, per_bin long, at long, opened_capacity int, capacity int, bin_used int")
    frame = F.broadcast(frame) if len(runs) <= SMALL_PLAN else frame
    placed = ranked.join(frame, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        (F.col("bin_lo") + F.expr("(rank - lo) div per_bin")).alias("bin_id"),
        (F.col("at") + F.pmod(nth, F.col("per_bin")) * F.col("length")).alias("bin_offset"),
        "capacity",
        "opened_capacity",
        "bin_used",
    )
