import hashlib
import json
import random
import time

from pyspark.sql import functions as F

from tessera.operators import audit, evaluate, service
from tessera.sources import io
from tessera.streaming import limits as live_limits
from tessera.streaming import service as live


def plain_limit(rows, per_minute):
    state, out = {}, {}
    for user, event, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        recent = [x for x in state.get(user, []) if t - x < 60]
        out[event] = len(recent) < per_minute
        state[user] = recent + [t] * out[event]
    return out


def requests(seed=1, n=300):
    random.seed(seed)
    return [(random.choice("ab"), k, random.choice([random.uniform(0, 400), float(random.randrange(0, 400, 30))])) for k in range(n)]


def test_rate_limit(spark):
    rows = requests()
    frame = spark.createDataFrame(rows, "user_id string, event_id long, at double")
    got = {r.event_id: r.allowed for r in service.rate_limit(frame, 5).collect()}
    assert got == plain_limit(rows, 5)
    edge = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 59.9), ("a", 3, 60.0)], "user_id string, event_id long, at double")
    assert [r.allowed for r in service.rate_limit(edge, 1).orderBy("event_id").collect()] == [True, False, True]


def test_rate_limit_in_pieces(spark):
    """A key's requests behind a silent minute are judged apart, with the same answers, on any times; one key is dealt to many
    tasks."""
    rng = random.Random(9)
    rows, t = [], -400.0
    for k in range(600):
        t += rng.choice([0.0, 0.5, 7.0, 59.0, 60.0, 60.5, 119.0, 121.0, 300.0])
        rows.append((rng.choice([None, "a", "b", "b"]), k, t))
    frame = spark.createDataFrame([(u, k, t) for u, k, t in rows] + [("a", 1000, None), (None, 1001, None)], "user_id string, event_id long, at double").repartition(5)
    got = {r.event_id: r.allowed for r in service.rate_limit(frame, 2).collect()}
    assert got == plain_limit([(u or "", k, t) for u, k, t in rows], 2) | {1000: True, 1001: True}
    busy = spark.range(20_000).selectExpr("'k' user_id", "id event_id", "cast(id div 20 * 200 + id % 20 as double) at")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = service.rate_limit(busy.repartition(8), 5).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.count_if("allowed").alias("ok")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r.n for r in spread) < 12_000 and sum(r.ok for r in spread) == 5_000


def streamed(spark, tmp_path, frame, name, make, batches, key):
    path = str(tmp_path / name)
    for k in range(batches):
        frame.where(f"{key} % {batches} = {k}" if key == "none" else key.format(k=k)).coalesce(1).write.mode("append").json(path)
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).json(path)
    query = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    # state with timeouts keeps a query running when its data is done
    rows, end = frame.count(), time.monotonic() + 120
    while query.isActive and spark.table(name).count() < rows and time.monotonic() < end:
        time.sleep(0.2)
    query.stop()
    return spark.table(name)


def test_rate_limit_stream(spark, tmp_path):
    rows = requests(2, 120)
    frame = spark.createDataFrame(rows, "user_id string, event_id long, at double")
    got = streamed(spark, tmp_path, frame, "limited", lambda s: live.rate_limit_stream(s, 5), 3, "at >= {k} * 140 and at < ({k} + 1) * 140")
    assert {r.event_id: r.allowed for r in got.collect()} == plain_limit(rows, 5)


def test_rate_limit_by_time(spark, tmp_path):
    """Requests that come in any order within the watermark get the answers of the batch form; state goes on from one run to
    the next, and from what the batch form allowed."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng = random.Random(12)
        rows = sorted(((rng.choice("ab"), k, float(rng.choice([rng.randrange(100, 700), rng.randrange(100, 700, 20)]))) for k in range(160)), key=lambda r: r[2] + rng.uniform(0, 90))
        want = plain_limit([("b", -1, 60.0), ("b", -2, 95.0), *rows], 4)
        since = spark.createDataFrame([("b", 60.0), ("b", 95.0)], "user_id string, at double")
        schema, path = "user_id string, event_id long, ts timestamp", str(tmp_path / "in")
        got = {}
        for k, part in enumerate((rows[:60], rows[60:], [("z", 1000, 5000.0)], [("z", 1001, 9000.0), ("a", 1002, 50.0)])):  # the last but one moves the watermark, the last is too late
            frame = spark.createDataFrame(part, "user_id string, event_id long, at double").select("user_id", "event_id", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"))
            frame.coalesce(1).write.mode("append").json(path)
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)
            out = live_limits.rate_limit_by_time(source, 4, "100 seconds", since).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            assert out.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
            found = {r.event_id: r.allowed for r in spark.read.schema("user_id string, event_id long, at double, allowed boolean").parquet(str(tmp_path / "out")).collect()}
            assert got.items() <= found.items()
            got = found
        assert {e: ok for e, ok in got.items() if e < 1000} == {e: ok for e, ok in want.items() if e >= 0}
        assert 1002 not in got and got[1000]
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def records(spark, n=6):
    rows = [("log", k + 1, "query", f"r{k}", "system", {"user_name": "Ann", "n": str(k)}, f"{k}.0", f"id{k}") for k in range(n)]
    return spark.createDataFrame(rows, "log_id string, seq long, event string, request_id string, actor string, details map<string,string>, ts string, record_id string")


def test_audit(spark, tmp_path):
    sealed = audit.seal(records(spark))
    path = str(tmp_path / "audit")
    io.append_audit(sealed.where("seq <= 3"), path)
    io.append_audit(sealed.where("seq > 3"), path)
    log = io.read_audit(spark, path)
    assert audit.verify(log).first().asDict() == {"log_id": "log", "ok": True, "checked": 6, "broken_at": None, "reason": None}
    assert log.select("details").first().details.startswith('{"n":')
    changed = log.withColumn("actor", F.when(F.col("seq") == 3, "x").otherwise(F.col("actor")))
    assert audit.verify(changed).first().asDict() == {"log_id": "log", "ok": False, "checked": 2, "broken_at": "id2", "reason": "record_hash mismatch"}
    assert audit.verify(log.where("seq <> 2")).first().reason == "prev_hash mismatch"
    assert audit.verify(log.where("seq < 5")).first().ok  # a missing tail can't be seen


ODD_TEXTS = ["plain", 'quo"te\\back', "tab\tline\nret\r\b\f", "\x01\x7f", "é字\u2028", "😀 𐍈", ""]


def test_audit_is_canonical_json(spark):
    """Hashes are those of the record as JSON with sorted keys, no blanks and ASCII alone, the previous hash among its fields."""
    rows = [("log", k, t, f"r{k}", "system", {"b": t, "a": "x"}, ts, f"id{k}") for k, (t, ts) in enumerate(zip(ODD_TEXTS, ["1732672000.500000", "12.0", "1.250000", "3.000000", "1732672000.123456", "0.1", "7.10"], strict=True))]
    frame = spark.createDataFrame(rows, records(spark).schema)
    prev = "GENESIS"
    for r in sorted(audit.seal(frame).collect(), key=lambda r: r.seq):
        body = {"event": r.event, "request_id": r.request_id, "actor": r.actor, "details": r.details, "ts": float(r.ts), "record_id": r.record_id, "prev_hash": prev}
        assert r.prev_hash == prev
        prev = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert r.record_hash == prev
    assert audit.verify(audit.seal(frame)).first().ok


def tree(rng, depth=3):
    kind = rng.randrange(9 if depth else 7)
    if kind == 7:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 8:
        return {rng.choice(["b", "a", "Z", "é", "q\"", "user_name", "ß😀"]): tree(rng, depth - 1) for _ in range(rng.randrange(5))}
    return rng.choice([None, True, False, rng.randrange(-(10**rng.randrange(1, 30)), 10**20), rng.uniform(-1, 1) * 10 ** rng.randrange(-30, 30), 0.92, 1e16, 1e-7, -0.0, 100.0, rng.choice(ODD_TEXTS)])


def plain_scrub(details):
    hide = lambda v: f"<redacted:{hashlib.sha256(v.encode()).hexdigest()[:8]}>"
    return {k: hide(v) if isinstance(v, str) and any(h in k.lower() for h in ("ssn", "phone", "email", "mrn", "dob", "name", "address")) else v for k, v in details.items()}


def body(event, request, actor, details, ts, record, prev):
    fields = {"event": event, "request_id": request, "actor": actor, "details": details, "ts": ts, "record_id": record, "prev_hash": prev}
    return json.dumps(fields, sort_keys=True, separators=(",", ":"), default=str)


def test_typed_details(spark, tmp_path):
    """Details of any JSON type, as text and as variants, hash as json.dumps has them; sealed logs are read back and verified."""
    rng = random.Random(3)
    trees = [{rng.choice(["user_name", "g", "list", "Phone", "é"]): tree(rng) for _ in range(rng.randrange(5))} for _ in range(150)]
    rows = [("log", k + 1, "response", f"r{k}", "agent", json.dumps(t, ensure_ascii=k % 2 == 0), f"{k}.5", f"id{k}") for k, t in enumerate(trees)]
    frame = spark.createDataFrame(rows, "log_id string, seq long, event string, request_id string, actor string, details string, ts string, record_id string")
    frame = frame.withColumn("details", audit.canonical_json(F.col("details"), True))
    prev, want = "GENESIS", {}
    for k, t in enumerate(trees):
        prev = want[k + 1] = hashlib.sha256(body("response", f"r{k}", "agent", plain_scrub(t), k + 0.5, f"id{k}", prev).encode()).hexdigest()
    sealed = audit.seal(frame)
    assert {r.seq: r.record_hash for r in sealed.collect()} == want
    io.append_audit(sealed.where("seq <= 70"), str(tmp_path / "log"))
    io.append_audit(sealed.where("seq > 70"), str(tmp_path / "log"))
    assert audit.verify(io.read_audit(spark, str(tmp_path / "log")), block=16).first().asDict() == {"log_id": "log", "ok": True, "checked": 150, "broken_at": None, "reason": None}
    # structs with nulls, and variants
    typed = spark.sql("select 'log' log_id, 1L seq, 'query' event, 'r' request_id, 'api' actor, named_struct('stream', false, 'g', 0.92D, 'citations', array('b#c1', null), 'seal', cast(null as string), 'n', 3) details, '1.50' ts, 'id' record_id")
    want = hashlib.sha256(body("query", "r", "api", {"stream": False, "g": 0.92, "citations": ["b#c1", None], "seal": None, "n": 3}, 1.5, "id", "GENESIS").encode()).hexdigest()
    variant = typed.withColumn("details", F.parse_json(F.to_json("details", {"ignoreNullFields": "false"})))
    assert audit.seal(typed).first().record_hash == audit.seal(variant).first().record_hash == want
    assert audit.seal(typed.withColumn("details", F.lit(None).cast("string"))).first().details == "{}"


def test_chains_go_on(spark, tmp_path):
    """Batches appended one after another are one chain; a repeated batch and records that come again change nothing."""
    rows = [(f"log{k % 3}", k // 3 + 1, "query", f"r{k}", "system", {"n": str(k)}, f"{k}.0", f"id{k}") for k in range(60)]
    frame = spark.createDataFrame(rows, records(spark).schema)
    whole = {(r.log_id, r.seq): (r.prev_hash, r.record_hash) for r in audit.seal(frame).collect()}
    path = str(tmp_path / "log")
    assert io.read_heads(spark, path) is None
    # the second batch brings some records again, the third only those of one chain
    for number, part in ((0, frame.where("seq <= 7")), (1, frame.where("seq > 4 and seq <= 12 and log_id <> 'log2'")), (1, frame.where("seq > 4 and seq <= 12 and log_id <> 'log2'")), (2, frame.where("log_id = 'log2' and seq > 7")), (3, frame.where("seq > 12"))):
        io.append_batch(part, path, number)
    log = io.read_audit(spark, f"{path}/records")
    assert {(r.log_id, r.seq): (r.prev_hash, r.record_hash) for r in log.collect()} == whole and log.count() == 60
    assert all(r.ok and r.checked == 20 for r in audit.verify(log).collect())
    assert {r.log_id: (r.head_seq, r.head_hash) for r in io.read_heads(spark, path).collect()} == {f"log{k}": (20, whole[f"log{k}", 20][1]) for k in range(3)}
    later = audit.verify(log.where("seq > 7"), io.read_heads(spark, path, 1))
    assert [(r.ok, r.checked) for r in later.where("log_id <> 'log2'").collect()] == [(True, 13)] * 2
    assert not audit.verify(log.where("seq > 7")).first().ok


def plain_verify(rows):
    prev = "GENESIS"
    for n, (seq, record, before, own, good) in enumerate(rows):
        if before != prev:
            return False, n, record, "prev_hash mismatch"
        if not good:
            return False, n, record, "record_hash mismatch"
        prev = own
    return True, len(rows), None, None


def test_verify_in_blocks(spark):
    """Any record changed or lost, at borders of blocks or not, with blocks of any size."""
    rng = random.Random(7)
    rows = [(f"log{c:02}", k + 1, "query", f"r{k}", "system", {"n": str(k)}, f"{k}.0", f"id{c}-{k}") for c in range(40) for k in range(rng.choice([1, 2, 9, 30]))]
    sealed = [r.asDict() for r in audit.seal(spark.createDataFrame(rows, records(spark).schema)).collect()]
    kept, plain = [], {}
    for c in range(40):
        chain = sorted((r for r in sealed if r["log_id"] == f"log{c:02}"), key=lambda r: r["seq"])
        for _ in range(c % 3):
            at = rng.randrange(len(chain))
            if rng.random() < 0.5 and len(chain) > 1:
                chain.pop(at)
            else:
                chain[at]["actor"] = "intruder"
        kept += chain
        plain[f"log{c:02}"] = plain_verify([(r["seq"], r["record_id"], r["prev_hash"], r["record_hash"], r["actor"] == "system") for r in chain])
    frame = spark.createDataFrame(kept, audit.seal(records(spark)).schema)
    for block in (1, 4, 7, 1 << 16):
        assert {r.log_id: (r.ok, r.checked, r.broken_at, r.reason) for r in audit.verify(frame, block=block).collect()} == plain


def test_verify_spreads_a_chain(spark):
    """Records of a single chain are never put in order in one task: windows over records are by block, and only blocks' own
    rows, one each, by chain."""
    plan = audit.verify(audit.seal(records(spark)))._jdf.queryExecution().optimizedPlan().toString()
    over = [x for x in plan.splitlines() if "Window [" in x and ("row_number" in x or "lag(record_hash" in x)]
    assert over and all("block#" in x for x in over)
    rows = spark.range(100_000).selectExpr("'log' log_id", "id + 1 seq", "cast(id as string) record_id", "cast(id as string) prev_hash", "cast(id + 1 as string) record_hash", "'x' body")
    spread = rows.select(F.floor(F.col("seq") / 1024).alias("b")).distinct().count()
    assert spread == 98 and audit.verify(rows, block=1024).first().reason == "prev_hash mismatch"


def test_audit_lines(spark, tmp_path):
    """Logs kept as canonical lines, with details of any type, are verified; so are chains written here."""
    def log(forge):
        prev, lines = "GENESIS", []
        for k in range(40):
            rec = {"event": "response", "request_id": f"r{k}", "actor": "api", "details": {"blocked": k % 2 == 0, "g": 0.1 * k, "t": ODD_TEXTS[k % 7], "n": [1, None]}, "ts": 1732672000.123 + k, "record_id": f"id{k}", "prev_hash": prev}
            prev = hashlib.sha256(json.dumps(rec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
            rec["record_hash"] = prev
            if forge and k == 30:
                rec["actor"] = "intruder"
            lines.append(json.dumps(rec, sort_keys=True, separators=(",", ":")))
        return "\n".join(lines) + "\n\n"

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text(log(False))
    (tmp_path / "logs" / "b.jsonl").write_text(log(True))
    wrong = '{"event":"query","request_id":"r1","actor":"x","details":{},"ts":1,"record_id":"forged","prev_hash":"WRONG","record_hash":"WRONG"}\n'
    (tmp_path / "logs" / "c.jsonl").write_text(log(False).strip() + "\n" + wrong)
    got = {r.log_id[-7]: (r.ok, r.checked, r.broken_at, r.reason) for r in audit.verify(io.read_audit_lines(spark, str(tmp_path / "logs"))).collect()}
    assert got == {"a": (True, 40, None, None), "b": (False, 30, "id30", "record_hash mismatch"), "c": (False, 40, "forged", "prev_hash mismatch")}
    io.write_audit_chain(audit.seal(records(spark)), str(tmp_path / "own"))
    assert audit.verify(io.read_audit_lines(spark, str(tmp_path / "own"))).first().ok


def test_seal_and_limit_of_a_long_chain(spark):
    """Work is linear in the records of a chain and in the requests of a key."""
    rows = spark.range(200_000).selectExpr("'log' log_id", "id seq", "'query' event", "'r' request_id", "'system' actor", "map('n', cast(id as string)) details", "'1.0' ts", "cast(id as string) record_id")
    assert audit.verify(audit.seal(rows)).first().asDict() == {"log_id": "log", "ok": True, "checked": 200_000, "broken_at": None, "reason": None}
    busy = spark.range(200_000).selectExpr("'k' user_id", "id event_id", "cast(id as double) / 10 at")
    got = service.rate_limit(busy, 60)
    assert got.where("allowed").count() == sum(1 for k in range(200_000) if k % 600 < 60)


def test_keys_however_many(spark, tmp_path):
    (tmp_path / "keys").write_text("# comment\n" + "\n".join(f"key{k}" for k in range(120_000)) + "\n\nkey5\n")
    keys = io.read_keys(spark, str(tmp_path / "keys"), "own, key7")
    assert keys.count() == 120_001
    asked = spark.createDataFrame([("key119999",), ("own",), ("# comment",), ("",), ("other",)], "api_key string")
    assert {r.api_key: r.authorised for r in service.authorise(asked, keys).collect()} == {"key119999": True, "own": True, "# comment": False, "": False, "other": False}
    (tmp_path / "none").write_text("# only a comment\n")
    assert [r.api_key for r in io.read_keys(spark, str(tmp_path / "none")).collect()] == [r.api_key for r in io.read_keys(spark, None).collect()]


def test_health_and_readiness(spark):
    assert service.health(spark).first().status == "ok"
    chunks = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "doc_id string, text string")
    assert service.readiness(chunks).first().asDict() == {"ready": True, "chunks": 3, "documents": 2}
    assert not service.readiness(chunks.limit(0)).first().ready


def test_seal_stream(spark, tmp_path):
    rows = records(spark)
    head, tail = audit.canonical(F.struct("*"))
    bodies = rows.select("log_id", "seq", head.alias("head"), tail.alias("tail"))
    got = streamed(spark, tmp_path, bodies, "chain", live.seal_stream, 2, "seq > {k} * 3 and seq <= ({k} + 1) * 3")
    want = {r.seq: r.record_hash for r in audit.seal(rows).collect()}
    assert {r.seq: r.record_hash for r in got.collect()} == want


def test_metrics_stream(spark, tmp_path):
    frame = spark.createDataFrame([(k % 120, k % 2 == 0, False, 2.0, 3, 4) for k in range(40)], "s int, blocked boolean, needs_hitl boolean, latency_ms double, tokens_in int, tokens_out int")
    frame = frame.select(F.timestamp_seconds(F.col("s")).alias("ts"), "blocked", "needs_hitl", "latency_ms", "tokens_in", "tokens_out")
    path = str(tmp_path / "m")
    frame.write.json(path)
    query = live.metrics_stream(spark.readStream.schema(frame.schema).json(path)).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "mc")).start()
    query.awaitTermination(120)
    assert [(r.requests_total, r.requests_blocked) for r in spark.table("windows").collect()] == [(40, 20)]


def test_scrub(spark):
    got = spark.createDataFrame([({"userEmail": "a@b", "dose": "5", "NAME": "x"},)], "d map<string,string>").select(audit.scrub(F.col("d")).alias("d")).first().d
    assert got["dose"] == "5" and got["userEmail"].startswith("<redacted:") and got["NAME"].startswith("<redacted:") and len(got["NAME"]) == 19


def test_metrics_and_events(spark):
    rows = spark.createDataFrame([(10.0, True, False, 3, 1), (20.0, False, True, 4, 2)], "latency_ms double, blocked boolean, needs_hitl boolean, tokens_in long, tokens_out long")
    text = service.prometheus_text(service.service_metrics(rows)).first().text
    assert "clinical_requests_total 2\n" in text and "clinical_latency_avg_ms 15.0\n" in text and text.endswith("clinical_tokens_out_total 3\n") and text.count("\n") == 18
    empty = service.service_metrics(rows.where("false")).first()
    assert empty.requests_total == 0 and empty.latency_avg_ms == 0
    said = 'A "b". C\n\\d. é😀. '
    events = service.sse_events(spark.createDataFrame([(1, said), (2, None)], "id long, a string"), "id", "a").orderBy("id", "seq").collect()
    frames = [json.dumps({"request_id": "1", "delta": x}) for x in said.split(". ")] + [json.dumps({"request_id": "1", "done": True}), json.dumps({"request_id": "2", "delta": ""}), json.dumps({"request_id": "2", "done": True})]
    assert [r.frame for r in events] == [f"data: {x}\n\n" for x in frames] and [r.seq for r in events] == [0, 1, 2, 3, 4, 0, 1]


def test_keys(spark, tmp_path):
    path = tmp_path / "keys.txt"
    path.write_text("#c\n k1 \n\nk2\n")
    keys = io.read_keys(spark, str(path), "k3, ,k1")
    assert {r.api_key for r in keys.collect()} == {"k1", "k2", "k3"}
    assert {r.api_key for r in io.read_keys(spark, None).collect()} == {"demo-key-123"}
    rows = spark.createDataFrame([(1, "k1"), (2, "no"), (3, None), (4, "")], "i int, api_key string")
    assert [r.authorised for r in service.authorise(rows, keys).orderBy("i").collect()] == [True, False, False, False]


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("b.txt", "two\nlines"), ("a.txt", "one"), ("c.md", "no"), ("my notes+é%20.txt", "odd")):
        (tmp_path / "d" / name).write_text(text)
    assert [(r.doc_id, r.text) for r in io.read_text_folder(spark, str(tmp_path / "d")).orderBy("doc_ord").collect()] == [("a", "one"), ("b", "two\nlines"), ("my notes+é%20", "odd")]
    (tmp_path / "g.jsonl").write_text('{"id": "1", "query": "q", "must_contain": ["m"]}\n\n{"id": "2", "query": "r", "min_groundedness": 0.5}\n')
    examples = io.read_examples(spark, str(tmp_path / "g.jsonl"))
    io.write_examples(examples, str(tmp_path / "out"))
    again = io.read_examples(spark, str(tmp_path / "out")).orderBy("id").collect()
    assert [(r.id, r.must_contain, r.expected_citations, r.min_groundedness) for r in again] == [("1", ["m"], [], 0.35), ("2", [], [], 0.5)]
    (tmp_path / "r.json").write_text('{\n"pass_rate": 0.5\n}')
    gate = evaluate.regression_gate(io.read_report(spark, str(tmp_path / "r.json"))).first()
    assert not gate.passed and len(gate.failures) == 2


def test_metrics_of_runs(spark):
    runs = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "d"])], "retrieved array<string>, relevant array<string>")
    r, s = F.col("retrieved"), F.col("relevant")
    got = runs.select(evaluate.precision_at(r, s, 2), evaluate.recall_at(r, s, 4), evaluate.reciprocal_rank(r, s), evaluate.precision_at(r, s, 9), evaluate.hit_at(r, s, 1)).first()
    assert tuple(got) == (0.5, 1.0, 0.5, 0.5, 0.0)
    assert evaluate.evaluate_run(runs.where("false")).first().mrr == 0.0
    none = runs.select(F.array().cast("array<string>").alias("retrieved"), "relevant")
    assert evaluate.evaluate_run(none).first().precision_at_1 == 0.0


def test_eval(spark):
    base = ("1", "q", "Metformin 500 mg is taken daily [doc]", "Metformin 500 mg is taken daily", False, "", 10, 5, 3.25, ["a#c0"], ["doc"], ["metformin"], ["insulin"], 0.35)
    bad = ("2", "q", "Unrelated words about the moon insulin", "Metformin", True, "why", 10, 5, 3.35, [], ["x#c1"], ["metformin"], ["insulin"], 0.35)
    cols = "id string, query string, answer string, context_text string, blocked boolean, block_reason string, tokens_in long, tokens_out long, latency_ms double, citations array<string>, expected_citations array<string>, must_contain array<string>, must_not_contain array<string>, min_groundedness double"
    cases = {r.id: r for r in evaluate.eval_cases(spark.createDataFrame([base, bad], cols)).collect()}
    assert cases["1"].passed and not cases["2"].passed
    assert cases["2"].failures[0] == "blocked: why" and "missing fact: metformin" in cases["2"].failures and "forbidden fact present: insulin" in cases["2"].failures and len(cases["2"].failures) == 6
    report = evaluate.eval_report(evaluate.eval_cases(spark.createDataFrame([base, bad], cols))).first()
    assert (report.total, report.passed, report.pass_rate) == (2, 1, 0.5)
    assert evaluate.eval_report(evaluate.eval_cases(spark.createDataFrame([], cols))).first().total == 0
