"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative kept for each group."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean
from .components import block_forest, connected_components

THRESHOLD = 0.93
#: Vectors of the sample that the cells are fitted on, over all labels.
SAMPLE = 40_000
#: Vectors that a cell may hold and vectors of a block, rows of a block that are multiplied at once, and cells up to which
#: one level of them will do.
TARGET, BLOCK, STRIP, FLAT = 8_192, 8_192, 1_024, 1_024


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest and the bytes of each usable vector; nulls for vectors that are null, empty, zero or not finite throughout.
    Vectors are scaled by a power of two, which is exact, so that no square over- or underflows."""
    for batch in batches:
        digests, packed = [], []
        for v in batch.column("v"):
            v = v.values
            x = None if v is None or v.null_count or not len(v) else v.to_numpy(zero_copy_only=False)
            if x is None or not np.isfinite(x).all() or not x.any():
                digests.append(None)
                packed.append(None)
                continue
            x = x + x.dtype.type(0)  # no negative zeros
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            packed.append(x.tobytes() if x.dtype == np.float32 else np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).tobytes())
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != "v"]
        yield pa.RecordBatch.from_arrays([*[c for _, c in rest], pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], [*[n for n, _ in rest], "dg", "b"])


def _matrix(column, kind: str) -> np.ndarray:
    """Unit rows in double precision."""
    x = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def spherical_kmeans(x: np.ndarray, k: int, turns: int = 8, seed: int = 1) -> np.ndarray:
    """k unit centroids of unit rows."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(turns):
        home = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        norm = np.sqrt((sums**2).sum(1))
        centroids = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centroids)
    return centroids


class Level:
    """Unit centroids, how far apart they are, and for unit rows the nearest one and the others that are near enough.

    If x is nearest to c and y to c', the plane between both centroids lies between x and y. Vectors of a cosine of at least
    t are at most sqrt(2 - 2t) apart, so x can link to a vector of c' only where it is no farther than that from the plane.
    """

    def __init__(self, centroids: np.ndarray, threshold: float):
        self.centroids, self.reach = centroids, math.sqrt(2 - 2 * threshold) + 1e-9
        self.apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 1e-24))

    def __len__(self) -> int:
        return len(self.centroids)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row, and a matrix of those within reach, the nearest among them."""
        near = x @ self.centroids.T
        home = near.argmax(1)
        return home, (near[np.arange(len(x)), home][:, None] - near) / self.apart[home] <= self.reach


class Cells:
    """Cells of one or two levels, fitted by spherical k-means on a sample x of n vectors; each holds about `target`."""

    def __init__(self, x: np.ndarray, n: int, threshold: float, target: int, flat: int = FLAT):
        k = max(1, -(-n // target))
        self.top = Level(spherical_kmeans(x, k if k <= flat else math.isqrt(k - 1) + 1), threshold)
        self.low: list[Level | None] = [None] * len(self.top)
        if k > flat:
            home, _ = self.top(x)
            for c in range(len(self.top)):
                mine = x[home == c]
                inner = min(len(mine), -(-n * len(mine) // (len(x) * target)))
                if inner > 1:
                    self.low[c] = Level(spherical_kmeans(mine, inner), threshold)
        self.first = np.cumsum([0] + [1 if low is None else len(low) for low in self.low])

    def copies(self, x: np.ndarray, n: int) -> float:
        """How many blocks each of n vectors will be sent to, judged by a sample of them."""
        home, rows, cells = self(x)
        of = np.bincount(home, minlength=self.first[-1]) * (n / len(x))
        away = np.bincount(cells, minlength=self.first[-1]) * (n / len(x))
        own, more = np.ceil(of / BLOCK), np.ceil(away / BLOCK)
        return float((of * (own + more) + away * own).sum() / n)

    @classmethod
    def best(cls, x: np.ndarray, n: int, threshold: float) -> Cells:
        """Cells of the size that sends the fewest copies: small ones where vectors lie in separate groups, large ones where
        they lie all about and most cells are near each other."""
        found, least = None, math.inf
        for target in (TARGET, TARGET // 4, TARGET // 16, TARGET // 64):
            if found is not None and n // target > len(x) // 8:
                break
            cells = cls(x, n, threshold, target)
            sent = cells.copies(x[:4_000], n)
            if sent < 0.9 * least:
                found, least = cells, sent
            if n <= target:
                break
        return found

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cell of each row; and rows and cells for every lower cell that may hold the home of a vector that the row
        must be compared with. Each pair is compared once: in the cell of the lower number."""
        top, close = self.top(x)
        home = np.empty(len(x), np.int64)
        rows, cells = [], []
        for c in range(len(self.top)):
            at = np.nonzero(close[:, c] & (c <= top))[0]
            if not len(at):
                continue
            own = top[at] == c
            if self.low[c] is None:
                inner, near = np.zeros(len(at), np.int64), np.ones((len(at), 1), bool)
            else:
                inner, near = self.low[c](x[at])
            home[at[own]] = self.first[c] + inner[own]
            near &= ~own[:, None] | (np.arange(near.shape[1])[None, :] < inner[:, None])
            r, cell = np.nonzero(near)
            rows.append(at[r])
            cells.append(self.first[c] + cell)
        return home, np.concatenate(rows), np.concatenate(cells)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels link where their cosine in double precision is at least the threshold.

    1. Equal vectors of a label form a class with a count; only one of each is compared.
    2. Cells of at most about TARGET vectors are fitted for each label by spherical k-means, in two levels where there are
       many, so that a vector meets about the root of their number. They are fitted on a sample of at most `sample`
       vectors (a documented bound, and with it one of the broadcast table: cells steer the work and never the result).
    3. A vector goes to its home cell, and to every cell whose border is near enough for a link. Cells are cut into
       blocks; block pairs are compared as matrix products, so that a cell of any size is spread over many tasks.
       A block pair returns link counts and a spanning forest, never its pairs.

    Vectors that are null, zero, or hold a null or non-finite component, vectors with a null label and rows with a null
    vec_id link with nothing and are kept. Vectors of different lengths never link. Rows that repeat a vec_id are judged each
    by its own vector, and each counts as another vector. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "float32" if single else "float64"
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), F.size(vectors[vector_col]).alias("dim"), vectors[vector_col].cast("array<float>" if single else "array<double>").alias("v"))
    rows = scratch.put(rows.mapInArrow(lean(_digest), "uid long, vec_id long, label string, dim int, dg binary, b binary"))
    usable = rows.where("dg is not null and label is not null and vec_id is not null")
    classes = scratch.put(usable.groupBy("label", "dim", "dg").agg(F.min("uid").alias("node"), F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("b").alias("b")))

    sizes = {(r.label, r.dim): r.n for r in classes.groupBy("label", "dim").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    part = F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.8 * sample / max(1, total)))
    taken = classes.where(part).select("label", "dim", "b").limit(sample).toPandas()
    cells = {key: Cells.best(_matrix(frame["b"], kind), sizes[key], threshold) for key, frame in taken.groupby(["label", "dim"])}
    shared = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, dim), frame in batch.groupby(["label", "dim"]):
                x = _matrix(frame["b"], kind)
                found = shared.value.get((label, dim))
                if found is None:  # no vector of the label was sampled: one cell
                    home, index, more = np.zeros(len(x), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
                else:
                    home, index, more = found(x)
                index = np.concatenate([np.arange(len(x)), index])
                cell = np.concatenate([home, more])
                yield pd.DataFrame({"label": label, "dim": dim, "cell": cell, "home": np.arange(len(cell)) < len(x), "node": frame["node"].to_numpy()[index], "m": frame["m"].to_numpy()[index], "b": frame["b"].to_numpy()[index]})

    key = ["label", "dim", "cell"]
    placed = scratch.put(classes.select("label", "dim", "node", "m", "b").mapInPandas(lean(assign), "label string, dim int, cell long, home boolean, node long, m long, b binary"))
    counted = placed.groupBy(*key).agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g"))
    counted = counted.select(*key, F.expr(f"(h + {BLOCK - 1}) div {BLOCK}").alias("nh"), F.expr(f"(g + {BLOCK - 1}) div {BLOCK}").alias("ng"))
    work = placed.join(scratch.put(counted), key).withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("ng"))))
    # home blocks are 0 .. nh-1 and the others nh .. nh+ng-1; pairs are (i, j), i <= j, with i a home block
    work = work.withColumn("block", F.when(F.col("home"), F.col("block")).otherwise(F.col("block") + F.col("nh")))
    upto = F.when(F.col("home"), F.col("nh") + F.col("ng")).otherwise(F.col("nh"))
    work = work.where("nh > 0").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), upto - 1)))
    work = work.select(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "m", "b")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        left = frame[frame["block"] == i]
        right = left if i == j else frame[frame["block"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "parent": []}).astype("int64")
        x = _matrix(left["b"], kind)
        y = x if i == j else _matrix(right["b"], kind)
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        m, back, out = right["m"].to_numpy(), np.zeros(len(b), np.int64), []
        for at in range(0, len(x), STRIP):
            part, own = x[at : at + STRIP], a[at : at + STRIP]
            linked = part @ y.T >= threshold
            if i == j:
                linked &= own[:, None] != b[None, :]
            out += [(n, c, n) for n, c in zip(own, linked @ m, strict=True) if c]
            back += left["m"].to_numpy()[at : at + STRIP] @ linked
            out += [(n, 0, p) for n, p in block_forest(linked, own, b)]
        if i != j:
            out += [(n, c, n) for n, c in zip(b, back, strict=True) if c]
        return pd.DataFrame(out, columns=["node", "links", "parent"]).astype("int64")

    met = scratch.put(work.groupBy(*key, "i", "j").applyInPandas(compare, "node long, links long, parent long"))
    comp = connected_components(met.where("node <> parent"), scratch, "node", "parent")
    counts = met.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0").withColumnRenamed("node", "linked")
    named = classes.select("label", "dim", "dg", "node", "rep", "m").join(counts, F.col("node") == F.col("linked"), "left").join(comp.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    named = scratch.put(named.select(F.col("label").alias("c_label"), F.col("dim").alias("c_dim"), F.col("dg").alias("c_dg"), "rep", "component", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    heads = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("head")).withColumnRenamed("component", "of")
    found = scratch.put(named.join(heads, F.col("component") == F.col("of"), "left").select("c_label", "c_dim", "c_dg", "n_links", F.coalesce("head", "rep").alias("component_id")))
    scratch.keep(rows, found)
    rows = rows.select("vec_id", "label", "dim", "dg")
    out = rows.join(found, (F.col("label") == F.col("c_label")) & (F.col("dim") == F.col("c_dim")) & (F.col("dg") == F.col("c_dg")) & F.col("vec_id").isNotNull(), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
