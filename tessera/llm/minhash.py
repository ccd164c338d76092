"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, lean, may_be_among, slices, trim
from .components import block_forest, connected_components

WORDS, PERCENT = 5, 75
#: 39 permutations give 78 values, a minimum and a maximum each; 26 bands of 3 values lose a pair at similarity 0.75
#: with a probability of (1 - 0.75 ** 3) ** 26 < 1e-6.
PERMUTATIONS, ROWS = 39, 3
BANDS = 2 * PERMUTATIONS // ROWS
#: Members of a bucket are compared in blocks of so many documents; block pairs are handed out in groups of about so many rows.
BLOCK, PAIRS_ROWS = 256, 2_000

_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes methods know ASCII letters and white space only."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; the whole sequence is one where words are fewer than size."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, size)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * _BASE + h[i : n - width + 1 + i]
    return np.unique((out ^ (out >> np.uint64(32))) * _BASE)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of 2 * PERMUTATIONS values: minima, then maxima, of each non-empty set under each permutation."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every = np.concatenate(sets)
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    for k in range(PERMUTATIONS):
        x = (every ^ _FLIP[k]) * _MULTIPLY[k]
        for at, reduce in ((k, np.minimum), (k + PERMUTATIONS, np.maximum)):
            m = reduce.reduceat(x, starts) * _BASE
            out[:, at] = (m >> np.uint64(32)).astype(np.uint32)
    return out


def least_agreement(values: int = 2 * PERMUTATIONS, similarity: float = PERCENT / 100, risk: float = 1e-9) -> int:
    """The number of equal values below which two sets of that similarity fall with a probability under the risk."""
    below, t = 0.0, 0
    while True:
        below += math.comb(values, t) * similarity**t * (1 - similarity) ** (values - t)
        if below >= risk:
            return t
        t += 1


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        for lo, hi in slices(texts, lambda t: len(t) + 1, 1_500_000):
            words = [words_of(t) for t in texts[lo:hi]]
            sets = [shingle_hashes(w) for w in words]
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full).view(np.uint8).reshape(len(full), -1) if full else ())
            joined = [b" ".join(w) if w else None for w in words]
            digests = [hashlib.blake2b(j, digest_size=16).digest() if j else None for j in joined]
            sigs = [next(signed).tobytes() if len(s) else None for s in sets]
            packed = [tool.compress(j) if j else None for j in joined]
            own = [batch.column(c).slice(lo, hi - lo) for c in ("uid", "doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), *[pa.array(x, pa.binary()) for x in (digests, sigs, packed)]], ["uid", "doc_id", "text_key", "n_shingles", "dg", "sig", "z"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdDecompressor()
    kept: OrderedDict[bytes, np.ndarray] = OrderedDict()
    size = 0

    def shingles(z: bytes) -> np.ndarray:
        nonlocal size
        if z not in kept:
            kept[z] = shingle_hashes(tool.decompress(z).split())
            size += len(kept[z])
            while size > 2_000_000 and len(kept) > 1:
                size -= len(kept.popitem(last=False)[1])
        kept.move_to_end(z)
        return kept[z]

    for batch in batches:
        a, b, za, zb = (batch.column(c).to_pylist() for c in ("a", "b", "za", "zb"))
        keep = []
        for i in range(len(a)):
            s, t = shingles(za[i]), shingles(zb[i])
            if 100 * min(len(s), len(t)) < PERCENT * max(len(s), len(t)):
                continue
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= PERCENT * (len(s) + len(t) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, as a matrix product over the shingles that two sets or more have."""
    out = np.zeros((len(left), len(right)), np.float32)
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out


def _values(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), 2 * PERMUTATIONS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may link by their sizes and signatures."""
    least = least_agreement()
    for batch in batches:
        n, m = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
        same = (_values(batch.column("sa").to_pylist()) == _values(batch.column("sb").to_pylist())).sum(1)
        keep = pa.array((100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (same >= least))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])


def _pairs_of_blocks(frame):
    """(i == j, places of the left block, places of the right one) for each block pair of a group."""
    key = frame[["bk", "i", "j"]].to_numpy()
    block = frame["block"].to_numpy()
    order = np.lexsort((block, key[:, 2], key[:, 1], key[:, 0]))
    cuts = np.nonzero((key[order][1:] != key[order][:-1]).any(1))[0] + 1
    for at in np.split(order, cuts):
        i, j = key[at[0], 1:]
        left, right = at[block[at] == i], at[block[at] == j]
        if len(left) and len(right):
            yield i == j, left, right


def _screen(frame):
    """Of block pairs, the members that may link across components by their signatures; see near_duplicates."""
    values, n, comp, bands = _values(frame["sig"]), frame["n"].to_numpy(np.float64), frame["comp"].to_numpy(), frame["band"].to_numpy()
    keep, least = np.zeros(len(frame), bool), least_agreement()
    for alike, left, right in _pairs_of_blocks(frame):
        may = (100 * np.minimum(n[left][:, None], n[right]) >= PERCENT * np.maximum(n[left][:, None], n[right])) & (comp[left][:, None] != comp[right])
        if alike:
            may &= np.tri(len(left), dtype=bool).T
        a, b = np.nonzero(may)
        band = int(bands[left[0]])
        for at in range(0, len(a), 8192):
            p, q = left[a[at : at + 8192]], right[b[at : at + 8192]]
            same = values[p] == values[q]
            # what shares an earlier band meets there
            fresh = (same.sum(1) >= least) & ~same[:, : band * ROWS].reshape(len(p), band, ROWS).all(2).any(1)
            keep[p[fresh]] = keep[q[fresh]] = True
    return frame[["bk", "i", "j", "block", "node", "comp"]][keep]


def _compare(frame):
    """Links across components of block pairs, confirmed on full sets, as a spanning forest of components."""
    import pandas as pd

    tool, comp = zstandard.ZstdDecompressor(), frame["comp"].to_numpy()
    nodes, place = np.unique(frame["node"].to_numpy(), return_inverse=True)
    packed = dict(zip(place.tolist(), frame["z"], strict=True))
    sets: dict[int, np.ndarray] = {}

    def set_of(k: int) -> np.ndarray:
        if k not in sets:
            if len(sets) > 4 * BLOCK:
                sets.clear()
            sets[k] = shingle_hashes(tool.decompress(packed[k]).split())
        return sets[k]

    links: set[tuple[int, int]] = set()
    for alike, left, right in _pairs_of_blocks(frame):
        s = [set_of(k) for k in place[left].tolist()]
        t = s if alike else [set_of(k) for k in place[right].tolist()]
        both = intersections(s, t)
        n, m = np.array([len(x) for x in s], np.float64), np.array([len(x) for x in t], np.float64)
        a, b = comp[left], comp[right]
        linked = (100 * both >= PERCENT * (n[:, None] + m - both)) & (a[:, None] != b)
        if linked.any():
            links.update(block_forest(linked, a, b))
    sets.clear()
    trim()
    return pd.DataFrame(sorted(links), columns=["a", "b"]).astype("int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, text_key, group_key.

    Words are lower-cased (A-Z); a document is its set of distinct 5-word shingles. Documents are linked where 100 times
    the intersection reaches 75 times the union; component_id is the smallest doc_id reachable over links. text_key is a
    hash of the text as it stands; group_key numbers the components, whatever ids their documents have.

    1. Each text is hashed once to a signature of minima and maxima. Documents with the same words form a class, and only
       one of each goes on.
    2. Classes that share a band form a bucket. Every member meets two pivots of its bucket, its first and its last;
       pairs that may link by their signatures are confirmed on full sets, and components are found. A bucket of any size gives at most twice as many pairs
       as members, and a large family collapses at once.
    3. In buckets that still hold several components, members outside the largest one meet all others of the bucket, in
       blocks. Signatures go first: only pairs that may link, in the first band they share, send their texts on, and
       for those all intersections of a block pair come from matrix products and return a spanning forest. No member is
       left out, whatever the bucket's size, and no bucket's pairs are written out.

    Pairs may link by their signatures where they agree on so many values that a link falls below that with a probability
    under 1e-9.

    Nulls: a null text is empty; documents without words have an empty set, link with nothing and are kept. A null doc_id
    joins no class: component_id is null and kept is true. Rows that repeat a doc_id are judged each by its own text. An
    empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(docs[text_col], F.lit(""))
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("_text"))
    signed = scratch.put(texts.mapInArrow(lean(_sign), "uid long, doc_id long, text_key long, n_shingles long, dg binary, sig binary, z binary"))
    with_words = signed.where("n_shingles > 0 and doc_id is not null")
    one = with_words.groupBy("dg").agg(F.min("uid").alias("node"), F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.put(one)

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(k, F.substring("sig", k * 4 * ROWS + 1, F.lit(4 * ROWS))).alias("bk")))
    banded = classes.select("node", F.explode(bands).alias("b")).select("node", "b.band", "b.bk")
    shared = scratch.put(banded.groupBy("bk").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("c")).where("c > 1"))
    members = scratch.put(may_be_among(banded, "bk", shared.select("bk")).join(shared, "bk"))

    pairs = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = pairs.union(members.where("node <> first and node <> last").select(F.col("node").alias("a"), F.col("last").alias("b"))).distinct()
    signs = classes.select("node", "n", "sig")
    left = pairs.join(signs, F.col("a") == F.col("node")).select("a", "b", F.col("n").alias("na"), F.col("sig").alias("sa"))
    both = left.join(signs, F.col("b") == F.col("node")).select("a", "b", "na", F.col("n").alias("nb"), "sa", F.col("sig").alias("sb"))
    pairs = scratch.put(both.mapInArrow(lean(_likely), "a long, b long"))
    packed = _texts(scratch, signed, pairs.select("a").union(pairs.select("b")))
    left = pairs.join(packed, F.col("a") == F.col("uid")).select("a", "b", F.col("z").alias("za"))
    both = left.join(packed, F.col("b") == F.col("uid")).select("a", "b", "za", F.col("z").alias("zb"))
    links = scratch.put(both.mapInArrow(lean(_confirm), "a long, b long"))
    scratch.drop(packed)
    comp = scratch.put(connected_components(links, scratch))

    more = _across(scratch, members, comp, classes, signed)
    if more is not None:
        wider = scratch.put(connected_components(more, scratch).select(F.col("node").alias("c"), F.col("component").alias("wide")))
        alone = wider.join(comp, F.col("c") == F.col("node"), "left_anti").select(F.col("c").alias("node"), F.col("wide").alias("component"))
        comp = comp.join(wider, F.col("component") == F.col("c"), "left").select("node", F.coalesce("wide", "component").alias("component")).union(alone)
    named = scratch.put(classes.select("node", "rep").join(comp.withColumnRenamed("node", "member"), F.col("node") == F.col("member")).select("node", "rep", "component"))
    heads = named.groupBy("component").agg(F.min("rep").alias("head")).withColumnRenamed("component", "of")
    found = named.join(heads, F.col("component") == F.col("of")).select(F.col("node").alias("member"), "component", "head")
    final = classes.select("dg", "node", "rep").join(found, F.col("node") == F.col("member"), "left")
    final = scratch.put(final.select(F.col("dg").alias("class_dg"), F.coalesce("head", "rep").alias("component_id"), F.coalesce("component", "node").alias("group_key")))
    scratch.keep(signed, final)
    rows = signed.select("doc_id", "n_shingles", "text_key", "dg")
    out = rows.join(final, (F.col("dg") == F.col("class_dg")) & F.col("doc_id").isNotNull(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_key", "group_key")


def _texts(scratch: Scratch, signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, z) of the wanted nodes, which come in a single column."""
    nodes = scratch.put(wanted.toDF("wanted").distinct())
    texts = may_be_among(signed.where("z is not null").select("uid", "z"), "uid", nodes)
    return scratch.put(texts.join(nodes, F.col("uid") == F.col("wanted")).select("uid", "z"))


def _across(scratch: Scratch, members: DataFrame, comp: DataFrame, classes: DataFrame, signed: DataFrame) -> DataFrame | None:
    """Links between the components of buckets that hold several, or None where there is nothing to compare. Pivots, and
    with them buckets of up to three, have met all others already."""
    inner = members.where("c > 3 and node <> first and node <> last").select("bk", "band", "node")
    inner = scratch.put(inner.join(comp.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("bk", "band", "node", F.coalesce("component", "node").alias("comp")))
    sizes = inner.groupBy("bk", "comp").agg(F.count("*").alias("c"))
    top = F.max(F.struct("c", "comp")).alias("top")
    open_ = sizes.groupBy("bk").agg(F.sum("c").alias("total"), top, F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n: F.expr(f"({n} + {BLOCK - 1}) div {BLOCK}")
    open_ = open_.select("bk", F.col("top.comp").alias("main"), blocks("total - top.c").alias("few"), blocks("top.c").alias("many"), F.expr("total - top.c").alias("outside"), F.col("top.c").alias("inside"))
    seen = Observation()
    rows = F.sum(F.col("outside") * (F.col("few") + F.col("many")) + F.col("inside") * F.col("few"))
    open_ = scratch.put(open_.observe(seen, rows.alias("rows")).drop("outside", "inside"))
    if not seen.get["rows"]:
        return None
    live = inner.join(open_, "bk")
    # members outside the main component are in blocks 0 .. few-1, those in it behind; block pairs are (i, j), i < few
    outside = F.col("comp") != F.col("main")
    block = F.pmod(F.xxhash64("node"), F.when(outside, F.col("few")).otherwise(F.col("many"))) + F.when(outside, F.lit(0)).otherwise(F.col("few"))
    upto = F.when(outside, F.col("few") + F.col("many")).otherwise(F.col("few"))
    live = live.select("bk", "band", "node", "comp", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), upto - 1)).alias("other"))
    live = live.select("bk", "band", "node", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    signs = classes.select(F.col("node").alias("member"), "n", "sig")
    live = live.join(signs, F.col("node") == F.col("member")).drop("member")
    # block pairs are dealt to groups of about PAIRS_ROWS rows, so that small ones share a call
    group = lambda n: F.pmod(F.xxhash64("bk", "i", "j"), F.lit(max(1, n // PAIRS_ROWS))).alias("g")
    likely = live.groupBy(group(seen.get["rows"])).applyInPandas(_screen, "bk long, i long, j long, block long, node long, comp long")
    seen = Observation()
    maybe = scratch.put(likely.observe(seen, F.count("*").alias("rows")))
    if not seen.get["rows"]:
        return None
    near = maybe.join(_texts(scratch, signed, maybe.select("node")), F.col("node") == F.col("uid")).drop("uid")
    more = scratch.put(near.groupBy(group(seen.get["rows"])).applyInPandas(_compare, "a long, b long"))
    return None if more.isEmpty() else more
