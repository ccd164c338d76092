"""Exact top-k by inner product: ball trees per shard, branch and bound, the current k-th score shared between shards."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lean

#: Vectors, and bytes of them, that the cells are fitted on.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Packed bytes of a shard, queries that meet a shard in one task, vectors of a leaf, and sampled vectors of a cell.
SHARD, BLOCK, LEAF, CELL = 1 << 20, 4_096, 256, 16
#: Scores end here, so that their negatives are longs too.
MOST = (1 << 63) - 1


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(((x - centres) ** 2).sum(1))


class BallTree:
    """A tree of balls over rows of x: a node's centre, radius, and the plane by which its rows were dealt to two halves."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        self.lo, self.hi, self.left, centres, self.radius, self.plane = [], [], [], [], [], []
        todo = [(0, len(x))]
        while todo:
            lo, hi = todo.pop(0)
            rows = x[self.order[lo:hi]]
            centre = rows.mean(0) if len(rows) else np.zeros(x.shape[1])
            away = distances(rows, centre)
            at = len(self.lo)
            for field, value in ((self.lo, lo), (self.hi, hi), (self.left, 0), (centres, centre), (self.radius, away.max(initial=0.0)), (self.plane, None)):
                field.append(value)
            if hi - lo <= leaf or not away.any():
                continue
            far = rows[away.argmax()]
            toward = rows[distances(rows, far).argmax()] - far
            along = rows @ toward
            half = len(rows) // 2
            by = np.argpartition(along, half)
            self.plane[at] = (toward, along[by[half]])
            self.order[lo:hi] = self.order[lo:hi][by]
            # nodes are numbered in the order in which they are taken up, so that both halves get the next two numbers
            self.left[at] = len(self.lo) + len(todo)
            todo += [(lo, lo + half), (lo + half, hi)]
        self.centres, self.radius = np.array(centres), np.array(self.radius)
        self.leaves = [n for n, left in enumerate(self.left) if not left]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of x is dealt to by the planes."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.left[node]:
                out[rows] = node
            elif len(rows):
                toward, at = self.plane[node]
                right = x[rows] @ toward >= at
                todo += [(self.left[node], rows[~right]), (self.left[node] + 1, rows[right])]
        return out


def bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The most that the inner product of each row of q with any vector of each ball can be, rounded up; no bound where a
    double can't hold it."""
    with np.errstate(over="ignore", invalid="ignore"):
        long = np.sqrt((q**2).sum(1))[:, None]
        found = q @ centres.T + long * radius
        found += 1e-9 * (np.abs(found) + long * (np.sqrt((centres**2).sum(1)) + radius)) + 1e-3
    return np.where(np.isfinite(found), found, np.inf)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integers: exact in doubles where no partial sum can reach 2**53, else by Python's integers."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    longest = lambda a: float(np.sqrt((a**2).sum(1).max()))
    if longest(q) * longest(x) < 2.0**52:
        return (q @ x.T).astype(np.int64)
    whole = lambda a: np.array([[int(v) for v in row] for row in a], dtype=object).reshape(a.shape)
    return np.clip(whole(q) @ whole(x).T, -MOST, MOST).astype(np.int64)


class Search:
    """The best k of a tree's vectors for each query, ties to the smaller id."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int, leaf: int = LEAF):
        by = np.argsort(ids, kind="stable")
        self.x, self.k, self.at = x[by], k, np.append(by, -1)
        self.tree = BallTree(self.x, leaf)
        # rows of a leaf in order of id, by which ties are broken
        self.rows = {n: np.sort(self.tree.order[self.tree.lo[n] : self.tree.hi[n]]) for n in self.tree.leaves}

    def _descend(self, q: np.ndarray) -> np.ndarray:
        """The leaf that each query comes to by the child of the higher bound."""
        tree, out, todo = self.tree, np.zeros(len(q), np.int64), [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            if not tree.left[node]:
                out[rows] = node
            elif len(rows):
                kids = [tree.left[node], tree.left[node] + 1]
                b = bounds(q[rows], tree.centres[kids], tree.radius[kids])
                right = b[:, 1] > b[:, 0]
                todo += [(kids[0], rows[~right]), (kids[1], rows[right])]
        return out

    def _reach(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, leaves and bounds of all leaves whose bound, and that of every ball around them, is not below `least`."""
        tree, found, todo = self.tree, [], [(0, np.arange(len(q)), np.full(len(q), np.inf))]
        while todo:
            node, rows, b = todo.pop()
            if not tree.left[node]:
                found.append((rows, np.full(len(rows), node), b))
            elif len(rows):
                for kid in (tree.left[node], tree.left[node] + 1):
                    b = bounds(q[rows], tree.centres[[kid]], tree.radius[[kid]])[:, 0]
                    open_ = b >= least[rows]
                    todo.append((kid, rows[open_], b[open_]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def __call__(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the best k, -1 for places where there are fewer. What is below `least` may be missing.

        Each query first meets the leaf it comes to by the higher bounds, then all others in order of their bounds, until
        the next bound is below its k-th score so far.
        """
        self.score, self.row = np.full((len(q), self.k), -MOST), np.full((len(q), self.k), len(self.x))
        self.least, self.q, self.met = least.copy(), q, 0
        first = self._descend(q)
        self._meet(np.arange(len(q)), first)
        rows, leaves, b = self._reach(q, self.least)
        again = leaves != first[rows]
        rows, leaves, b = rows[again], leaves[again], b[again]
        by = np.lexsort((-b, rows))
        rows, leaves, b = rows[by], leaves[by], b[by]
        turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
        for t in range(turn.max(initial=-1) + 1):
            now = (turn == t) & (b >= self.least[rows])
            self._meet(rows[now], leaves[now])
        return self.score, self.at[self.row]

    def _meet(self, rows: np.ndarray, leaves: np.ndarray) -> None:
        for leaf in np.unique(leaves):
            mine, theirs = rows[leaves == leaf], self.rows[leaf]
            self.met += len(mine) * len(theirs)
            found = products(self.q[mine], self.x[theirs])
            best = np.argsort(-found, axis=1, kind="stable")[:, : self.k]
            score = np.concatenate([self.score[mine], np.take_along_axis(found, best, 1)], 1)
            row = np.concatenate([self.row[mine], theirs[best]], 1)
            # rows are in order of id, and one that doesn't exist comes last
            by = np.lexsort((row, -score), axis=-1)[:, : self.k]
            self.score[mine], self.row[mine] = np.take_along_axis(score, by, 1), np.take_along_axis(row, by, 1)
            self.least[mine] = np.maximum(self.least[mine], np.where(self.row[mine, -1] == len(self.x), -np.inf, self.score[mine, -1].astype(float)))


def _quantised(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, digests, packed, own = [], [], [], []
            for v in batch.column("v"):
                v = v.values
                x = None if v is None or v.null_count else np.floor(scale * v.to_numpy(zero_copy_only=False).astype(np.float64))
                if x is None or not np.isfinite(x).all():
                    for column in (dims, digests, packed, own):
                        column.append(None)
                    continue
                b = (x + 0.0).astype("<i4" if np.abs(x).max(initial=0) < 2**31 else "<f8").tobytes()
                dims.append(len(x))
                digests.append(hashlib.blake2b(b, digest_size=16, salt=str(len(x)).encode()).digest())
                packed.append(b)
                own.append(int(products(x[None, :], x[None, :])[0, 0]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asked"), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary()), pa.array(own, pa.int64())], ["id", "asked", "dim", "dg", "b", "own"])

    return lean(run)


def _matrix(column, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(b, "<i4" if len(b) == 4 * dim else "<f8") for b in column], np.float64).reshape(len(column), dim)


def top_inner_products(vectors: DataFrame, asked: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is asked for, the k rows of the highest inner products, all if fewer.

    Components become floor(scale * x) in double precision; products are exact integers, held at the ends of a long. Ties go
    to the smaller id. A row's own is left out, rows that repeat its id are not.

    1. Equal vectors become one class with its k + 1 smallest ids, which is all that can be among the best of any query; the
       window that finds them is limited within each task first, so that a vector that a third of the rows share costs one
       class. Queries of equal vectors are one query, whose best k + 1 serve each of them.
    2. A ball tree over a sample (at most SAMPLE vectors and SAMPLE_BYTES) deals all classes to cells by its planes; radii
       are taken over all classes. A cell is cut into shards of about SHARD bytes by hash. The sample steers the work only.
    3. A query first meets one shard of the cell of its highest bound. The k-th score found goes with it to all other shards
       whose cell's bound reaches it, and none else; they return only what reaches it too. In a shard, a ball tree is
       searched by branch and bound, leaves in order of their bounds. At most BLOCK queries meet a shard in a task; a shard is sent once for each of these blocks.

    Vectors that are null or hold a null or non-finite component (or one that overflows when scaled) take no part, nor do
    rows with a null id; zero and empty vectors do. Vectors of other lengths are no candidates. Rows that repeat an id or a
    vector are judged each. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), vectors[vector_col].cast("array<double>").alias("v")).where("id is not null")
    rows = scratch.put(rows.mapInArrow(_quantised(scale), "id long, asked boolean, dim int, dg binary, b binary, own long").where("dg is not null"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("dg").orderBy("id"))).where(F.col("nth") <= k + 1)
    classes = scratch.put(ranked.groupBy("dg").agg(F.first("dim").alias("dim"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("b").alias("b")))
    queries = scratch.put(rows.where("asked").groupBy("dg").agg(F.first("dim").alias("dim"), F.first("b").alias("b")))

    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("b")), F.lit(0)).alias("bytes")).first()
    share = 0.8 * min(SAMPLE / max(1, size.n), SAMPLE_BYTES / max(1, size.bytes))
    taken = classes.where(F.pmod(F.xxhash64("dg"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share))).select("dim", "b").limit(SAMPLE).toPandas()
    # cells of about a shard, as far as the sample can tell them apart
    leaf = max(CELL, math.ceil(len(taken) * SHARD / max(1, size.bytes)))
    trees = {dim: BallTree(_matrix(frame["b"], dim), leaf) for dim, frame in taken.groupby("dim")}
    shared = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, frame in batch.groupby("dim"):
                x, tree = _matrix(frame["b"], dim), shared.value.get(dim)
                cell = np.full(len(x), -1) if tree is None else tree.place(x)
                away = 0.0 if tree is None else distances(x, tree.centres[cell])
                yield frame.assign(cell=cell, away=away)[["dim", "cell", "away", "ids", "b"]]

    placed = scratch.put(classes.select("dim", "ids", "b").mapInPandas(lean(place), "dim int, cell long, away double, ids array<long>, b binary"))
    cells = scratch.put(placed.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.ceil(F.sum(F.greatest(F.length("b"), F.lit(64))) / SHARD).cast("long").alias("parts")))
    shards = placed.join(cells.select("dim", "cell", "parts"), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    shards = scratch.put(shards.select("dim", "cell", "part", "ids", "b"))
    # cells of the sample's trees only: as many as leaves
    radii = {(r.dim, r.cell): r.radius for r in cells.where("cell >= 0").select("dim", "cell", "radius").collect()}
    lists = {dim: sorted(c for d, c in radii if d == dim) for dim in trees}
    balls = spark.sparkContext.broadcast({dim: (np.array(at), trees[dim].centres[at], np.array([radii[dim, c] for c in at])) for dim, at in lists.items() if at})

    def route(batches: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, frame in batch.groupby("dim"):
                least = frame["least"].to_numpy(float)
                if dim not in balls.value:
                    near = np.ones((len(frame), 1), bool)
                    at = np.array([-1])
                else:
                    at, centres, radius = balls.value[dim]
                    b = bounds(_matrix(frame["b"], dim), centres, radius)
                    home = b.argmax(1)[:, None] == np.arange(len(at))
                    near = home if first else (b >= least[:, None]) | home
                index, cell = np.nonzero(near)
                home = np.ones(len(index), bool) if dim not in balls.value else home[index, cell]
                yield pd.DataFrame({"dg": frame["dg"].to_numpy()[index], "dim": np.int32(dim), "cell": at[cell], "home": home, "least": least[index], "b": frame["b"].to_numpy()[index]})

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"dg": [], "score": [], "id": []})
        dim = int(mine["dim"].iloc[0])
        ids = theirs["ids"].to_numpy()
        tree = Search(_matrix(theirs["b"], dim), np.array([i[0] for i in ids]), k + 1)
        score, row = tree(_matrix(mine["b"], dim), mine["least"].to_numpy(float))
        dg, out = mine["dg"].to_numpy(), []
        for n, (scores, places, least) in enumerate(zip(score.tolist(), row.tolist(), mine["least"].tolist(), strict=True)):
            found = sorted((-s, i) for s, p in zip(scores, places, strict=True) if p >= 0 and s >= least for i in ids[p].tolist())
            out += [(dg[n], -s, i) for s, i in found[: k + 1]]
        return pd.DataFrame(out, columns=["dg", "score", "id"])

    def meet(routed: DataFrame) -> DataFrame:
        routed = scratch.put(routed)
        key = ["dim", "cell", "part"]
        blocks = scratch.put(routed.groupBy(*key).agg(F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}").alias("blocks")))
        mine = routed.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("dg", F.lit(7)), F.col("blocks"))).select(*key, "block", "dg", "least", "b")
        theirs = shards.join(blocks, key).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*key, "block", "ids", "b")
        return scratch.put(mine.groupBy(*key, "block").cogroup(theirs.groupBy(*key, "block")).applyInPandas(search, "dg binary, score long, id long"))

    def parted(asking: DataFrame, first: bool) -> DataFrame:
        to = asking.mapInPandas(lean(lambda batches: route(batches, first)), "dg binary, dim int, cell long, home boolean, least double, b binary")
        to = to.join(cells.select("dim", "cell", "parts"), ["dim", "cell"])
        own = F.pmod(F.xxhash64("dg"), F.col("parts"))
        to = to.withColumn("part", own) if first else to.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where(~F.col("home") | (F.col("part") != own))
        return to.select("dim", "cell", "part", "dg", "least", "b")

    begun = meet(parted(queries.withColumn("least", F.lit(float("-inf"))), True))
    floors = begun.groupBy("dg").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low")).select(F.col("dg").alias("of"), F.when(F.col("n") > k, F.col("low") - F.abs("low") * 1e-12).alias("low"))
    asking = queries.join(floors, F.col("dg") == F.col("of"), "left").select("dg", "dim", "b", F.coalesce("low", F.lit(float("-inf"))).alias("least"))
    met = begun.union(meet(parted(asking, False)))
    best = met.withColumn("nth", F.row_number().over(Window.partitionBy("dg").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k + 1)
    best = best.groupBy("dg").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))).alias("found")).withColumnRenamed("dg", "of")
    best = scratch.put(best)
    scratch.keep(rows, best)
    out = rows.where("asked").select(F.col("id").alias("query_id"), "dg", F.struct((-F.col("own")).alias("s"), F.col("id").alias("i")).alias("self")).join(best, F.col("dg") == F.col("of"))
    at = F.array_position("found", F.col("self")).cast("int")
    rest = F.when(at > 0, F.concat(F.expr("slice(found, 1, cast(array_position(found, self) as int) - 1)"), F.slice("found", at + 1, k + 1))).otherwise(F.col("found"))
    out = out.select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("nth", "hit"))
    return out.select("query_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("hit.i").alias("vec_id"), (-F.col("hit.s")).alias("score"))
