"""op4, op10 and the pipeline: invariants, and plain versions of the same decisions."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import minhash, packing, quality, sharding, stages

SCHEMA = "doc_id long, text string"


def one_by_one(histogram, capacities, bin_cost=32):
    """Best-fit decreasing, a piece and a bin at a time, with the sizes weighed for every bin that is opened."""
    spare, bins = dict(histogram), []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [b for b in bins if b[0] - b[1] >= length]
            if fits:
                b = min(fits, key=lambda b: b[0] - b[1])
            else:
                spare[length] = max(1, spare[length])
                best = None
                for cap in sorted(c for c in capacities if c >= length):
                    room, fill = cap, Counter()
                    for n in sorted((n for n in spare if n <= length), reverse=True):
                        fill[n] = min(spare[n], room // n)
                        room -= fill[n] * n
                    cost = (cap + bin_cost) / (cap - room)
                    if best is None or cost < best[0]:
                        best = cost, cap, fill
                for n, k in best[2].items():
                    spare[n] -= k
                bins.append(b := [best[1], 0])
            b[1] += length
        spare[length] = 0
    return bins


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(30)}
    plan = packing.plan_bins(histogram, (16, 32, 64))
    used, count = defaultdict(int), Counter()
    for length, lo, hi, bin_lo, per_bin, at in plan.runs:
        for q in range(lo, hi):
            used[bin_lo + (q - lo) // per_bin] += length
            count[length] += 1
    assert count == Counter(histogram)
    ends = {b: (opened, cap, n) for lo, hi, opened, cap, n in plan.bins for b in range(lo, hi)}
    assert set(used) == set(ends) and all(ends[b][2] == n <= ends[b][1] <= ends[b][0] for b, n in used.items())
    assert all(cap == min(c for c in (16, 32, 64) if c >= n) for _, cap, n in ends.values())
    single = one_by_one(histogram, (16, 32, 64))
    assert sorted((opened, n) for opened, _, n in ends.values()) == sorted((b[0], b[1]) for b in single)
    cuts = packing.cut_runs(plan)
    assert sum(hi - lo for _, lo, hi, *_ in cuts) == sum(histogram.values())


def test_plan_of_every_length():
    """A plan has no bound on its runs: all lengths, with counts that divide badly."""
    rng = random.Random(3)
    histogram = {n: rng.randint(1, 9) for n in range(1, 2049)}
    plan = packing.plan_bins(histogram)
    assert sum(hi - lo for _, lo, hi, *_ in packing.cut_runs(plan)) == sum(histogram.values())
    used = sum((hi - lo) * n for lo, hi, _, _, n in plan.bins)
    assert used == sum(n * c for n, c in histogram.items()) > 0.99 * sum((hi - lo) * cap for lo, hi, _, cap, _ in plan.bins)


def test_pack_joins_large_plans(table, monkeypatch):
    rows = [(k, "w " * (k % 37)) for k in range(300)]
    few = packing.pack(table(rows, SCHEMA))
    want = Counter((r.length, r.capacity, r.bin_used) for r in few.collect())
    monkeypatch.setattr(packing, "SMALL_PLAN", 0)
    assert Counter((r.length, r.capacity, r.bin_used) for r in packing.pack(table(rows, SCHEMA)).collect()) == want


def test_pack(table):
    rng = random.Random(1)
    rows = [(k, "w " * rng.choice([0, 3, 700, 5000, rng.randint(1, 9000)])) for k in range(200)] + [(1, "a b"), (1, "a b"), (None, None), (None, None)]
    got = packing.pack(table(rows, SCHEMA)).collect()
    per_doc, bins = Counter(), defaultdict(list)
    for r in got:
        per_doc[r.doc_id] += r.length
        bins[r.bin_id].append(r)
    want = Counter()
    for i, t in rows:
        want[i] += len((t or "").split()) + 1
    assert per_doc == want
    for items in bins.values():
        at = 0
        for r in sorted(items, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        assert {r.bin_used for r in items} == {at} and at <= items[0].capacity <= items[0].opened_capacity
        assert items[0].capacity == min(c for c in packing.CAPACITIES if c >= at)
    assert sorted(bins) == list(range(len(bins)))
    assert sum(per_doc.values()) / sum(b[0].capacity for b in bins.values()) > 0.9
    assert packing.pack(table([], SCHEMA)).count() == 0


@pytest.mark.parametrize("case", ["mixed", "hot", "tiny", "empty"])
def test_shards(table, case):
    rng = random.Random(7)
    rows = {
        "mixed": [(k, f"text {rng.randint(0, 150)}" if k % 2 else f"own {k}") for k in range(1003)],
        "hot": [(k, "same") for k in range(500)] + [(k, f"own {k}") for k in range(500, 1001)] + [(3, "same")] * 30 + [(None, None)] * 20,
        "tiny": [(1, "a"), (2, None), (2, None)],
        "empty": [],
    }[case]
    got = sharding.balanced_shards(table(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    loads = Counter(r.shard for r in got)
    assert not rows or max(loads[s] for s in range(8)) - min(loads[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(loads[s]))
    if case == "mixed":
        groups = defaultdict(Counter)
        for r in got:
            groups[r.text_crc32][r.shard] += 1
        pairs = lambda n: n * (n - 1) // 2
        together = sum(pairs(n) for g in groups.values() for n in g.values()) / sum(pairs(sum(g.values())) for g in groups.values())
        assert together > 0.8  # by hash alone it would be 1 / 8


def plain_shards(spark, rows, shards=8, rounds=3, slack=0.02):
    """The same decisions, a row at a time: rows of a group move to where most of it is, as quotas let them, and surplus rows
    fill the shards below their share. Only the hashes come from Spark."""
    from math import isqrt

    n = len(rows)
    texts = [t or "" for _, t in rows]
    size, crc = [len(t.encode()) + 1 for t in texts], [zlib.crc32(t.encode()) for t in texts]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "uid long, t string").withColumn("h", F.xxhash64("t"))
    hashes = {"h": "h", "dealt": "xxhash64(uid, 7)", "part": "xxhash64(uid, 11)"}
    hashes |= {f"u{r}": f"xxhash64(uid, {r})" for r in range(rounds)} | {f"h{r}": f"xxhash64(h, {r})" for r in range(rounds)} | {f"s{s}": f"xxhash64(h, {s})" for s in range(shards)}
    by_uid = {r.uid: r for r in frame.selectExpr("uid", *[f"{v} {k}" for k, v in hashes.items()]).collect()}
    shard = [by_uid[k].dealt % shards for k in range(n)]
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[t].append(k)
    group_rows = [len(groups[t]) for t in texts]
    linked = [k for k in range(n) if group_rows[k] > 1]
    share = n / shards
    for turn in range(rounds):
        loads = Counter(shard[k] for k in linked)
        wish = {}
        for t, members in groups.items():
            held = Counter(shard[k] for k in members)
            wish[t] = max((c, by_uid[members[0]][f"s{s}"], s) for s, c in held.items())[2]
        flow = Counter((shard[k], wish[texts[k]]) for k in linked if shard[k] != wish[texts[k]])
        if not flow:
            break
        ratio = {}
        for (s, t), c in flow.items():
            back = min(c, flow.get((t, s), 0))
            into = sum(m - min(m, flow.get((t, x), 0)) for (x, y), m in flow.items() if y == t) or 1
            ratio[s, t] = min(c, back + max(0.0, (1 - slack) * share - loads[t]) * (c - back) / into) / c
        for k in linked:
            draw = by_uid[k][f"u{turn}" if group_rows[k] > max(1.0, share / 4) else f"h{turn}"] % 1_000_000 / 1_000_000
            if shard[k] != wish[texts[k]] and draw < ratio[shard[k], wish[texts[k]]]:
                shard[k] = wish[texts[k]]
    buckets = max(64, isqrt(n))
    order = lambda k: ((buckets if group_rows[k] > 1 else 0) + by_uid[k].part % buckets, k)
    held = [sorted((k for k in range(n) if shard[k] == s), key=order) for s in range(shards)]
    target = [n // shards + (s < n % shards) for s in range(shards)]
    spare = [k for s in range(shards) for k in held[s][: max(0, len(held[s]) - target[s])]]
    held = [h[max(0, len(h) - target[s]) :] for s, h in enumerate(held)]
    for s in range(shards):
        missing = target[s] - len(held[s])
        held[s], spare = held[s] + spare[:missing], spare[missing:]
    return Counter((rows[k][0], size[k], crc[k], s, slot) for s in range(shards) for slot, k in enumerate(held[s]))


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_against_plain(spark, seed):
    rng = random.Random(seed)
    rows = [(k, f"text {rng.randint(0, 120)}" if rng.random() < 0.5 else "hot" if rng.random() < 0.3 * seed else f"own {k} é") for k in range(1500)] + [(None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.balanced_shards(docs).collect())
    assert got == plain_shards(spark, rows)


def test_pipeline(spark, sf, table):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        kept.append(docs.count())
        rows = {r.doc_id: r.text for r in before.collect()}
        if name == "quality_rules":
            ids, texts = list(rows), list(rows.values())
            assert {i for i, k in zip(ids, quality.measure(texts)["kept"], strict=True) if k} == {r.doc_id for r in docs.collect()}
        if name == "minhash_near_dedup":
            assert {r.doc_id for r in minhash.near_duplicates(before).where("kept").collect()} == {r.doc_id for r in docs.collect()}
    assert kept == sorted(kept, reverse=True) and kept[0] > kept[3] > 0
    assert docs.where("n_chars <> length(text)").count() == 0
    final = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in docs.collect()}


def test_near_duplicate_stage_odd(table, spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None), (3, None), (None, "a b c d e f"), (None, None)]
    rows += [(7, "one text of its own"), (7, "another one, no near copy of it"), (8, "p q  r s t"), (8, "p q r s t"), (9, "P q r s t")]
    docs = table(rows, SCHEMA)
    got = stages.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    left = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    assert [x for x in left if x[0] != "8"] == sorted([("1", "a b c d e f"), ("3", ""), ("3", ""), ("None", "a b c d e f"), ("None", ""), ("7", "one text of its own"), ("7", "another one, no near copy of it")])
    assert len([x for x in left if x[0] == "8"]) == 1
    assert stages.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pipeline_against_plain(table, spark, tmp_path):
    """All stages on a small corpus, each step done again by brute force: quality over all substrings, near duplicates over
    all pairs, secrets by a plain scan, packing a piece at a time over the library's token counts."""
    from test_dedup import plain_near
    from test_text import plain_linked

    from tessera.llm import secrets, tokens, toxicity

    rng = random.Random(21)
    make = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    base, rows = make(80), []
    for k in range(120):
        words = list(base) if k % 4 == 0 else make(rng.randint(4, 120))
        if k % 4 == 0:
            words[rng.randrange(80)] = f"edit{k}"
        if k % 7 == 0:
            words += make(12) * 4
        if k % 5 == 0:
            words.insert(3, "client_id: alice99 password = hunter22 token=abcdefabcdef99")
        if k % 3 == 1:
            words.insert(1, "stupid idiot")
        rows.append((k, " ".join(words)))
    docs = table(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    labels = [(k, 1, int(k % 3 == 1)) for k in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
    packed = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()

    bad = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).where("predicted = 1").collect()}
    assert bad
    plain = [(i, t) for i, t in rows if i not in bad]

    def good(text):
        w = text.split()
        n = len(w)
        spans = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in [next((x for x in range(n - j) if w[i + x] != w[j + x]), n - j)] if k]
        cover = lambda least: {p for i, j, k in spans if k >= least for s in (i, j) for p in range(s, s + k)}
        longest = max((k for _, _, k in spans), default=0)
        return not (n < 10 or 100 * len(cover(5)) > 20 * n or len(cover(10)) > 0.3 * n or (longest > 0.25 * n and longest > 25))

    judged = [(i, t) for i, t in plain if good(t)]
    assert 10 < len(judged) < len(plain)
    _, comp = plain_near(judged)
    judged = [(i, t) for i, t in judged if comp[i] == i]

    def hidden(text):
        out, at = "", 0
        for s, kind, e in plain_linked(text):
            out, at = out + text[at:s] + f"[{secrets.KINDS[kind]}]", max(at, e)
        return out + text[at:]

    want = sorted((i, hidden(t)) for i, t in judged)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == want and any("[weak]" in t for _, t in want)
    library = tokens._load(tokens.default_tokenizer()).whole
    sizes = {i: len(library.encode(t, add_special_tokens=False)) + 1 for i, t in want}
    assert Counter((r.doc_id, r.length) for r in packed) == Counter(sizes.items())
    plan = one_by_one(Counter(sizes.values()), packing.CAPACITIES)
    assert sorted({r.bin_id: r.bin_used for r in packed}.values()) == sorted(b[1] for b in plan)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_odd(table, spark, empty, tmp_path):
    rows = [] if empty else [(1, "plain words " * 3), (None, "no id but words " * 4), (2, None), (3, ""), (3, ""), (4, "token = abcdefabcdef99 " + " ".join(f"w{k}" for k in range(3000)))]
    docs = table(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    folder = str(tmp_path)
    spark.createDataFrame([] if empty else [(1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        got = after.collect()
        assert empty is False or not got
        if name != "best_fit_packing":
            assert after.columns == docs.columns, name
        if name == "secret_scan" and not empty:
            (row,) = [r for r in got if r.doc_id == 4]
            assert row.text.startswith("[assign] w0 w1") and row.n_chars == len(row.text)


def test_contract(spark, sf):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 13)) and "pipeline" in entry.queries()
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "minhash_near_dedup", "secret_scan", "best_fit_packing"]


def test_oracles(spark, sf):
    from tessera.llm import queries

    con = duckdb.connect()
    for t in "documents embeddings labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        frame = queries.queries()[name](spark, sf)
        found = con.execute(sql)
        order = [d[0] for d in found.description]
        assert sorted(order) == sorted(frame.columns), name
        assert Counter(tuple(r[c] for c in order) for r in frame.collect()) == Counter(found.fetchall()), name
