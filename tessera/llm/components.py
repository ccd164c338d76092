"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, scratch: Scratch, large: bool) -> tuple[DataFrame, int]:
    """One round, and how many edges it moved. A hub may hold a third of all rows: its minimum is a partial aggregate
    written to a table, and the join that hands the minimum out can be split by the engine, so no task needs a hub's rows
    together. Moves are counted while the result is written, so that no pass is spent on finding the end."""
    near = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        near = near.union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = scratch.put(near.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m")))
    joined = near.join(least, "x")
    if large:
        out = joined.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("x")).alias("moved"))
    else:
        out = joined.where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
        out = out.union(least.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"), F.lit(False).alias("moved")))
    seen = Observation()
    out = out.observe(seen, F.count_if("moved").alias("moved")).select("u", "v")
    result = scratch.put(out if large else out.distinct())
    scratch.drop(least)
    return result, seen.get["moved"]


def connected_components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): every node that has a link to another, and the smallest node it can reach.

    links: pairs of longs in columns a and b; order, repeats and self-links don't matter; pairs with a null are left out.
    The number of rounds grows with the logarithm of the longest path; the loop ends when neither kind of round moves an
    edge.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    seen = Observation()
    edges = scratch.put(edges.where("_a is not null and _b is not null and u <> v").select("u", "v").observe(seen, F.count("*").alias("n")))
    settled = False
    for _ in range(most_rounds if seen.get["n"] else 0):
        wide, moved = _star(edges, scratch, True)
        scratch.drop(edges)
        if settled and not moved:
            edges = wide
            break
        edges, again = _star(wide, scratch, False)
        scratch.drop(wide)
        settled = not again
        if settled and not moved:
            break
    else:
        if seen.get["n"]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def block_forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the block's links connect: each vector to the smallest of its component in the block."""
    best_l, best_r = left.copy(), right.copy()
    rows, cols = linked.any(1), linked.any(0)
    while True:
        r = np.minimum(best_r[cols], np.where(linked[:, cols], best_l[:, None], np.iinfo(np.int64).max).min(0)) if cols.any() else best_r[cols]
        best_r[cols] = r
        l = np.minimum(best_l[rows], np.where(linked[rows], best_r[None, :], np.iinfo(np.int64).max).min(1)) if rows.any() else best_l[rows]  # noqa: E741
        if (l == best_l[rows]).all():
            break
        best_l[rows] = l
    out = {(int(a), int(b)) for a, b in zip(left[rows], best_l[rows], strict=True) if a != b}
    return sorted(out | {(int(a), int(b)) for a, b in zip(right[cols], best_r[cols], strict=True) if a != b})
