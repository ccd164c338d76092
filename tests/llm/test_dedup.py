"""op1 and op3 against brute force, with the odd inputs their docstrings define."""

import math
import random

import numpy as np
import pytest

from tessera.llm import embeddings, minhash
from tessera.llm.common import Scratch
from tessera.llm.components import connected_components


def groups(nodes, pairs):
    lead = {n: n for n in nodes}

    def find(n):
        while lead[n] != n:
            n = lead[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            lead[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_near(rows):
    sets = {i: plain_set(t) for i, t in rows}
    ids = sorted(i for i in sets if i is not None)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, groups(ids, links)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = family(rng, make(120), 60, 5) + family(rng, make(60), 12, 3) + [" ".join(make(rng.randint(0, 40))) for _ in range(60)]
    texts += [texts[3]] * 25 + [texts[3].upper(), "", " \n", "one two", "one  two", "One Two", "one two three"]
    common = make(40)
    texts += [" ".join(common + make(rng.randint(5, 60))) for _ in range(40)]  # a passage that many share
    rng.shuffle(texts)
    return [(7 * k + 1, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(table, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = corpus(seed)
    sets, comp = plain_near(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(table(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), comp[i], comp[i] == i)


def test_near_duplicates_odd(table):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "A b  c d e f g"), (6, "other words of the same id"), (4, None), (3, None), (9, long), (8, long + " end"), (2, "")]
    got = minhash.near_duplicates(table(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1, r.kept, r.n_shingles) for r in got) == [
        (-1, -1, True, 3), (2, 2, True, 0), (3, 3, True, 0), (4, 4, True, 0), (5, 5, True, 3), (5, 5, True, 3), (6, 5, False, 3), (6, 6, True, 2), (8, 8, True, 59_997), (9, 8, False, 59_996),
    ]
    assert minhash.near_duplicates(table([], "doc_id long, text string")).count() == 0


def test_near_duplicates_large_unlinked_bucket(table):
    """Hundreds of texts that share most of their words with each other, so that they share buckets, and link in small groups
    only: no link is lost, and only pairs that may link by their signatures send their texts on."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for g in range(90):
        own = list(base)
        for at in rng.sample(range(100), 9):
            own[at] = f"g{g}x{at}"
        for c in range(4):
            text = list(own)
            for at in rng.sample(range(100), 1):
                text[at] = f"c{g}y{c}"
            rows.append((1000 - 4 * g - c, " ".join(text)))
    sets, comp = plain_near(rows)
    assert len(set(comp.values())) > 20
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(rows, "doc_id long, text string")).collect()}
    assert got == comp


def test_least_agreement():
    least = minhash.least_agreement(78, 0.75, 1e-9)
    below = lambda t: sum(math.comb(78, k) * 0.75**k * 0.25 ** (78 - k) for k in range(t))
    assert below(least) < 1e-9 <= below(least + 1) and least > 20


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, n).astype(np.uint64)) for n in (0, 5, 100, 300, 300)]
    got = minhash.intersections(sets, sets[1:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]


def test_signatures_estimate():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 2**63, 750).astype(np.uint64)
    pair = [np.concatenate([shared, rng.integers(0, 2**63, 125).astype(np.uint64)]) for _ in range(2)]
    same = [(lambda s: (s[0] == s[1]).mean())(minhash.signatures([np.unique(p) for p in pair]))]
    assert abs(same[0] - 0.75) < 0.2


def plain_vectors(rows, threshold=0.93):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, pairs = {i: 0 for i, _, _ in rows}, []
    for k, (i, v, lab) in enumerate(ok):
        for j, w, other in ok[k + 1 :]:
            if lab == other and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= threshold:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    return links, groups([i for i, _, _ in rows], pairs)


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(table, monkeypatch, block):
    for name in ("BLOCK", "TARGET", "STRIP"):
        monkeypatch.setattr(embeddings, name, block)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    rows = []
    for k in range(300):
        v = centers[k % 12] + rng.normal(size=16) * (0.05 if k % 3 else 0.35)
        rows.append((k * 3, [float(np.float32(x)) for x in v], int(k % 4 == 0)))
    rows += [(2000 + k, rows[7][1], rows[7][2]) for k in range(40)] + [(3000, [2 * x for x in rows[7][1]], rows[7][2])]
    links, comp = plain_vectors(rows)
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(table(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows) and sum(links.values()) > 1000
    for i, _, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], comp[i], comp[i] == i), i


def test_vectors_odd(table):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)]
    got = embeddings.near_duplicate_vectors(table(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert found[1] == (2, 1, True) and found[2] == (2, 1, False)
    assert all(found[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)) and found[None] == (0, None, True)
    assert embeddings.near_duplicate_vectors(table([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("flat", [100, 4])
def test_cells_find_all_pairs(flat):
    """In one level and in two, every linked pair meets once: in the lower of both home cells."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 8))[rng.integers(0, 30, 500)] + rng.normal(size=(500, 8)) * 0.25
    x /= np.sqrt((x * x).sum(1))[:, None]
    cells = embeddings.Cells(x[:300], len(x), 0.93, target=25, flat=flat)
    assert (cells.first[-1] > len(cells.top)) == (flat == 4)
    home, rows, visited = cells(x)
    visits = set(zip(rows.tolist(), visited.tolist(), strict=True))
    assert len(visits) == len(rows) and all(c < home[r] for r, c in visits)
    pairs = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    assert len(pairs) > 500 and any(home[i] != home[j] for i, j in pairs)
    for i, j in pairs:
        a, b = sorted((i, j), key=lambda k: home[k])
        assert home[a] == home[b] or (b, home[a]) in visits


def test_vectors_repeated_ids_and_extremes(table):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [1.0, 0.01], 1), (7, [0.01, 1.0], 1)]
    rows += [(20, [1e200, 0.0], 2), (21, [1e200, 1e190], 2), (22, [1e-200, 0.0], 3), (23, [2e-200, 0.0], 3), (24, [5e-324, 0.0], 3)]
    got = embeddings.near_duplicate_vectors(table(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [
        (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False),
        (20, 1, 20, True), (21, 1, 20, False), (22, 2, 22, True), (23, 2, 22, False), (24, 2, 22, False),
    ]


def test_cells_fit_the_data():
    """Vectors in separate groups are sent to no more blocks as the table grows; vectors that lie all about get large cells."""
    rng = np.random.default_rng(6)
    copies = []
    for n in (10_000, 50_000):
        x = rng.normal(size=(n // 1_000, 64))[rng.integers(0, n // 1_000, n)] + rng.normal(size=(n, 64)) * 0.1
        x /= np.sqrt((x * x).sum(1))[:, None]
        copies.append(embeddings.Cells.best(x[:8_000], n, 0.93).copies(x, n))
    assert copies[1] < 1.3 * copies[0] < 4
    x = rng.normal(size=(40_000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    assert embeddings.Cells.best(x[:8_000], len(x), 0.93).first[-1] <= 5


def test_components(spark):
    rng = random.Random(5)
    path = [(k, k + 1) for k in range(60)]
    hub = [(1000, 1001 + k) for k in range(200)]
    mixed = [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(70)]
    pairs = path + hub + mixed
    frame = spark.createDataFrame(pairs + [(None, 5), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(frame, Scratch(spark)).collect()}
    want = groups({n for p in pairs for n in p}, pairs)
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert connected_components(frame.where("false"), Scratch(spark)).count() == 0


def test_repeated_ids_in_sql(spark, table, tmp_path):
    """Rows are nodes, in the operators and in their SQL: rows that repeat an id, or have none, are judged each."""
    import duckdb

    from tessera.llm.oracles import oracle_sql

    a, b, c = ("one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen", "other words of no group at all here")
    docs = [(5, a), (3, a), (5, b), (9, b), (9, c), (9, c), (None, a), (None, c), (7, None)]
    vectors = [(5, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (5, [0.0, 1.0], 1), (9, [0.01, 1.0], 1), (None, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (4, [1.0, 0.0], 2)]
    table(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents"))
    table(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings"))
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    got = minhash.near_duplicates(spark.read.parquet(str(tmp_path / "documents"))).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.sql(oracle_sql()["op3_minhash_near_dedup"]).fetchall()))
    got = embeddings.near_duplicate_vectors(spark.read.parquet(str(tmp_path / "embeddings"))).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.sql(oracle_sql()["op1_embedding_near_dedup"]).fetchall()))
