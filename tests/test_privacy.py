import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import privacy as P
from tessera.operators import leaks
from tessera.operators.leaks import leaks_between
from tessera.plans import registry

NOTE = "Patient: Maria Gonzalez\nDOB: 03/14/1956\nMRN: AB12345\nSSN 123-45-6789, phone (214) 555-0147, mail m.g@example.org.\nSeen by Dr. Alan Turing on Jan 5, 2024; then Alan said hello to Mary Smith."


def plain_spans(text, enabled=C.PII_TYPES, thresholds=None, default=0.5):
    """All matches of the patterns; then a walk that keeps the first by (start, longer, surer) unless a later one is surer."""
    limit = thresholds or {}
    found = []
    for k, (kind, p, c) in enumerate(C.PII_PATTERNS):
        if kind in enabled and c >= limit.get(kind, default):
            found += [(m.start(), -len(m[0]), -c, k, kind, m[0]) for m in re.finditer(p, text)]
    for k, (p, c) in enumerate(C.NAME_PATTERNS):
        if "PERSON" in enabled and c >= limit.get("PERSON", default):
            found += [(m.start(1), -len(m[1]), -c, 99 + k, "PERSON", m[1]) for m in re.finditer(p, text) if not set(m[1].split()) & set(C.NOT_NAMES)]
    kept = []
    for x in sorted(found):
        if kept and x[0] < kept[-1][0] - kept[-1][1]:
            if x[2] < kept[-1][2]:
                kept[-1] = x
        else:
            kept.append(x)
    return [(x[0], x[0] - x[1], x[4], x[5], -x[2]) for x in kept]


def plain_redact(text, spans):
    seen, numbers, out = {}, {}, text
    for start, end, kind, raw, _ in reversed(spans):
        numbers[kind] = numbers.get(kind, 0) + 1
        name = next((p for p, o in seen.items() if o == raw), None)
        if name is None:
            name = f"[{kind}_{numbers[kind]}]"
            seen[name] = raw
        out = out[:start] + name + out[end:]
    return out, seen


def run(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = rows.withColumn("s", P.pii_spans(F.col("t"), **options)).withColumn("n", P.placeholders(F.col("s"))).withColumn("e", P.redaction_entries(F.col("s"), F.col("n")))
    rows = rows.withColumn("r", P.redact(F.col("t"), F.col("s"), F.col("n"))).withColumn("back", P.restore(F.col("r"), F.col("e"))).withColumn("seal", P.seal(F.col("e"), F.lit("salt")))
    return rows.orderBy("i").collect()


def test_note(spark):
    (row,) = run(spark, [NOTE])
    assert {"PHONE", "EMAIL", "MRN", "DATE", "SSN", "PERSON"} <= {x.entity_type for x in row.s}
    assert "123-45-6789" not in row.r and "m.g@example.org" not in row.r and "[SSN_1]" in row.r and "[EMAIL_1]" in row.r
    assert "([PHONE_1]" in row.r
    assert row.back == NOTE and re.fullmatch("[0-9a-f]{64}", row.seal)
    assert "MRN: AB12345" in [x.text for x in row.s]


def test_thresholds_and_reuse(spark):
    rows = run(spark, ["id 123 45 6789 end"], thresholds={"SSN": 0.9999, "ZIP": 0.99})
    assert not rows[0].s
    (row,) = run(spark, ["call 214-555-0147 or 214-555-0147 or 214-555-0199"])
    assert row.r == "call [PHONE_2] or [PHONE_2] or [PHONE_1]"


PARTS = ["123-45-6789", "123 45 6789", "214-555-0147", "a.b@c.org", "MRN: AB-1234", "12/31/2020", "2020-01-05", "Jan 5, 2020", "75001", "75001-1234", "4111 1111 1111 1111", "Dr. Ann Lee", "Mary Smith", "the ", " ", "\n", "é", "x", "Hospital Room", "Patient: Bob Ray"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12), min_size=15, max_size=25))
def test_against_plain(spark, parts):
    texts = [" ".join(p) if k % 2 else "".join(p) for k, p in enumerate(parts)]
    everything = (*C.PII_TYPES, "CREDIT_CARD")
    for row in run(spark, texts, enabled=everything):
        spans = plain_spans(row.t, everything)
        assert [(x.start, x.end, x.entity_type, x.text, x.confidence) for x in row.s] == spans
        out, seen = plain_redact(row.t, spans)
        assert row.r == out and [(e.placeholder, e.original) for e in row.e] == list(seen.items())
        assert row.seal == hashlib.sha256(("salt:" + "|".join(f"{k}={v}" for k, v in sorted(seen.items()))).encode()).hexdigest()


def test_leaks(spark):
    rows = spark.createDataFrame([("SSN 123-45-6789 of a@b.org", "it is 123-45-6789"), ("SSN 123-45-6789", "[SSN_1]")], "t string, a string")
    rows = rows.withColumn("s", P.pii_spans(F.col("t"))).withColumn("e", P.redaction_entries(F.col("s"), P.placeholders(F.col("s"))))
    got = rows.select(P.leaked_types(F.col("a"), F.col("e")).alias("l"), P.leak_count(F.col("a"), F.col("e")).alias("n")).collect()
    assert [(r.l, r.n) for r in got] == [(["SSN"], 1), ([], 0)]


def test_leak_scan_reads_whole_texts(spark, tmp_path):
    rows = [(1, "word " * 500 + "SSN 123-45-6789 and a.b@example.org"), (2, "SSN 123-45-6789"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (sorted(filter(None, r.leaked.split(","))), r.n_leaked) for r in registry.leak_scan(spark, str(tmp_path)).collect()}
    assert got == {1: (["EMAIL", "SSN"], 2), 2: (["SSN"], 1), 3: ([], 0)}


@pytest.mark.parametrize("text", ["", None])
def test_empty(spark, text):
    rows = spark.createDataFrame([(text,)], "t string").select(P.type_counts(P.pii_spans(F.coalesce("t", F.lit("")))).alias("m"))
    assert rows.first().m == {}


def test_leaks_between(spark):
    """Against the double loop: any request's originals in any answer, across lines, scripts, repeats and overlapping places."""
    rng = random.Random(6)
    originals = ["555-123-4567", "abc", None, "", "a@b.c", "Élan Müller", "aaaa", "aaaaaa", "line\ntwo", "字字字字", "😀😀😀😀", "x.y*z", "555-123-4567"] + ["".join(rng.choice("ab1-") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    answers = [(k, "".join(rng.choice("ab1-") for _ in range(rng.randint(0, 60)))) for k in range(120)]
    answers += [(200, "call 555-123-4567 or a@b.c"), (201, None), (202, ""), (203, "Élan Müller\nline\ntwo"), (204, "aaaaa"), (205, "字字字字字 😀😀😀😀"), (206, "xxy*z x.y*z"), (206, "aaaa again"), (None, "aaaa")]
    answers += [(300, "no leaks " * 20_000 + "555-123-4567")]
    got = leaks_between(spark.createDataFrame(answers, "answer_id long, text string"), spark.createDataFrame([(o,) for o in originals], "original string"))
    want = {(i, o) for i, t in answers for o in originals if i is not None and t is not None and o is not None and len(o) >= 4 and o in t}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    assert leaks_between(spark.createDataFrame([], "answer_id long, text string"), spark.createDataFrame([("abcd",)], "original string")).count() == 0


def test_leaks_of_many_lengths(spark):
    """Originals longer than what is looked up, that differ behind it, at the ends of texts and across pieces that are hashed
    at a time; no text meets originals by a gram that many have."""
    long = "x" * 70
    originals = [long + "1", long + "2", "é" * 24, "é" * 25, "555-123-4567", "abcd"]
    pad = "abc " * (leaks.PIECE // 4)
    answers = [(1, long + "1"), (2, long + "2" + long + "1"), (3, long), (4, "é" * 30), (5, "é" * 24), (6, pad[:-6] + "555-123-4567"), (7, "555-123-456"), (8, "ab"), (9, "cd"), (10, "a" * 3 + pad + "bcd")]
    frames = spark.createDataFrame(answers, "answer_id long, text string").coalesce(1), spark.createDataFrame([(o,) for o in originals], "original string")
    found = leaks_between(*frames)
    assert sorted(map(tuple, found.collect())) == sorted((i, o) for i, t in answers for o in originals if o in t)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "MapInArrow" in plan


def test_arrays_are_computed_once(spark, sf):
    """The optimizer's filters on what is exploded would compute spans and their map again."""
    for name in ("pii_map", "pii_spans"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"\d{3}-\d{2}-\d{4}") <= 4, name
