"""op11 against a double loop over Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import search


def plain(rows, k=10):
    scaled = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(scaled):
        if i % 100 == 0:
            found = sorted((-max(-search.MOST, min(search.MOST, sum(a * b for a, b in zip(v, w, strict=True)))), j) for m, (j, w) in enumerate(scaled) if m != n and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def got(table, rows, k=10):
    frame = table(rows, "vec_id long, embedding array<double>")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in search.top_inner_products(frame, F.col("vec_id") % 100 == 0, k).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_top_inner_products(table, seed, monkeypatch):
    """Groups, single vectors, one vector that a third of the rows share, ties, and trees, shards and blocks of all sizes."""
    for name, size in (("SHARD", 2_000), ("BLOCK", 3), ("LEAF", 8), ("SAMPLE", 200)):
        monkeypatch.setattr(search, name, size)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(int(i), (centres[i % 6] + rng.normal(size=8) * (0.05 if i % 2 else 2)).tolist()) for i in range(900)]
    rows += [(900 + i, [1.0, 0.5] * 4) for i in range(450)]
    rows += [(1500 + i, [float(x) for x in rng.integers(0, 2, 8)]) for i in range(120)]
    random.Random(seed).shuffle(rows)
    assert got(table, rows) == plain(rows)


def test_top_inner_products_odd(table):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [9.0, 9.0]), (5, [0.0, 0.0]), (6, [-1.0, 1e-9]), (7, [1.0]), (8, []), (100, []), (100, []), (200, [1.0, 2.0]), (200, [1.0, 2.0]), (200, [3.0, 2.0]), (300, [0.0, 0.0]), (400, [1e300, -1e300]), (401, [1e300, 1e299]), (402, [2.0**40, 2.0**41]), (500, [2.0**40 + 0.001, 1.0]), (600, [1.0] * 20_000), (601, [0.5] * 20_000), (700, [1e308, 1.0])]
    rows += [(801 + i, [1e200 * (i % 7), 1e290 * (i % 3)]) for i in range(300)]
    clean = [r for r in rows if r[0] != 700]  # overflows a double when scaled: takes no part
    assert got(table, rows) == plain(clean) and got(table, rows, 1) == plain(clean, 1)
    assert got(table, []) == [] and got(table, [(0, None)]) == [] and got(table, [(0, [1.0])]) == []


def test_ball_tree_prunes():
    """Vectors in groups: most are never met; the bound holds for every ball."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = np.floor(1024 * (centres[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 16)) * 0.02))
    tree = search.Search(x, np.arange(len(x)), 11)
    q = x[:200]
    score, row = tree(q, np.full(200, -np.inf))
    want = np.sort(-(q @ x.T), axis=1)[:, :11]
    assert (-score == want).all() and (np.take_along_axis(q @ x.T, row, 1) == score).all()
    assert tree.met < 0.15 * 200 * 20_000
    b = search.bounds(q, tree.tree.centres, tree.tree.radius)
    for node in range(len(tree.tree.lo)):
        own = tree.x[tree.tree.order[tree.tree.lo[node] : tree.tree.hi[node]]]
        assert ((q @ own.T).max(1) <= b[:, node]).all()
    # a floor from elsewhere leaves only what reaches it
    met = tree.met
    tree(q, score[:, 0].astype(float))
    assert tree.met <= met


def test_op11(spark, sf):
    from tessera.llm.queries import queries

    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in queries()["op11_exact_topk"](spark, sf).collect())
    assert found == plain(rows) and found
