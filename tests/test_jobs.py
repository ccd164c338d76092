"""The jobs: two runs over growing input, reruns, runs that broke off, command lines, and their SQL."""

import json
import logging
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import index_documents, queries, seal_days
from jobs.common import command_line, with_defaults
from tessera.operators import audit
from tessera.sources.session import new_folder

from test_queries import norm


def rows_of(frame):
    return sorted((tuple(sorted(r.asDict().items(), key=str)) for r in frame.collect()), key=str)


NOTES = [(1, "Patient: Maria Gonzalez called 555-123-4567 about her dose.", "en", "a"), (2, None, "de", "a"), (3, "Mail x@example.org or y@example.org. " * 60, None, "b"), (4, "", "en", None), (1, "the same id again", "fr", "b")]


def write(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.mode(mode).parquet(path)


def test_index_documents_grows(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    source, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "mark"))
    write(spark, NOTES[:2], source)
    first = index_documents.run(spark, source, output, checkpoint)
    assert [r.chunk_id for r in first.collect()] == ["1#c0"] and "read 2 documents" in caplog.text and "wrote 1 chunks" in caplog.text
    row = first.first()
    assert "555" not in row.text and "Gonzalez" not in row.text and row.text.startswith("Patient: [PERSON_1] called [PHONE_1] about") and row.personal == {"PERSON": 1, "PHONE": 1}
    kept = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(output) for f in names if f.startswith("part-")}
    write(spark, NOTES[2:], source)
    caplog.clear()
    second = rows_of(index_documents.run(spark, source, output, checkpoint))
    assert "read 3 documents" in caplog.text and len(second) > len(kept)
    now = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(output) for f in names if f.startswith("part-")}
    assert kept.items() < now.items()  # what the first run wrote is as it was
    caplog.clear()
    assert rows_of(index_documents.run(spark, source, output, checkpoint)) == second and "nothing new" in caplog.text
    # one run over everything gives the same rows
    assert rows_of(index_documents.run(spark, source, str(tmp_path / "o2"), str(tmp_path / "m2"))) == second
    assert {r.lang for r in spark.read.parquet(output).select("lang").distinct().collect()} == {"en", "fr", None}


def test_index_documents_settings(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    assert index_documents.run(spark, str(tmp_path / "none"), str(tmp_path / "o"), str(tmp_path / "c")).count() == 0
    write(spark, NOTES, str(tmp_path / "in"))
    config = {"strategy": "hierarchical", "options": {"child_size": 200}, "partition": "source", "carry": ["lang"], "types": ["EMAIL"]}
    out = index_documents.run(spark, str(tmp_path / "in"), str(tmp_path / "o2"), str(tmp_path / "c2"), config)
    assert out.where("level = 'child'").count() > 5 and out.where("contains(text, '@')").count() == 0 and out.where("contains(text, '555-123')").count() > 0
    with pytest.raises(ValueError, match="unknown settings"):
        with_defaults({"sizes": 3}, index_documents.DEFAULTS)
    assert new_folder(spark, "x") != new_folder(spark, "x")


def events(spark, days, start=0):
    rows = [(start + k, f"2024-03-{day:02} {hour:02}:00:00.000250", k % 3, kind, 1.5 * k, '{"k": %d, "tags": ["é"]}' % k) for k, (day, hour, kind) in enumerate((d, h, t) for d in days for h, t in ((1, "click"), (5, "error"), (5, "view"), (23, "click")))]
    return spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_seal_days_grows(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    source, output = str(tmp_path / "events"), str(tmp_path / "log")
    events(spark, (1, 2, 3)).write.parquet(source)
    first = rows_of(seal_days.run(spark, source, output, "2024-03-02"))
    assert len(first) == 8 and "sealed 8 events of 3 logs and 2 days through 2024-03-02" in caplog.text
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{output}/records") for f in names if f.startswith("part-")}
    events(spark, (4, 7), 100).write.mode("append").parquet(source)
    events(spark, (1,), 200).write.mode("append").parquet(source)  # too late
    second = rows_of(seal_days.run(spark, source, output))
    assert len(second) == 20 and set(first) < set(second)
    now = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{output}/records") for f in names if f.startswith("part-")}
    assert before.items() < now.items()
    assert rows_of(seal_days.run(spark, source, output)) == second and "nothing behind 2024-03-07" in caplog.text
    log = spark.read.parquet(f"{output}/records").drop("day")
    assert all(r.ok for r in audit.verify(log).collect()) and audit.verify(log).agg(F.sum("checked")).first()[0] == 20
    counts = {(str(r.day), r.event): r.events for r in spark.read.parquet(f"{output}/counts").collect()}
    assert counts["2024-03-07", "click"] == 2 and sum(counts.values()) == 20
    record = spark.read.parquet(f"{output}/records").where("request_id = '1'").first()
    assert json.loads(record.details) == {"value": 1.5, "props": {"k": 1, "tags": ["é"]}} and record.ts.endswith(".000250")


def test_seal_days_broken_off(spark, tmp_path, monkeypatch):
    """A run that ends before its mark is repeated with the same result; a lost day shows."""
    source, output = str(tmp_path / "events"), str(tmp_path / "log")
    events(spark, (1, 2, 3)).write.parquet(source)
    seal_days.run(spark, source, output, "2024-03-01")
    whole = rows_of(seal_days.run(spark, source, str(tmp_path / "whole")))
    with monkeypatch.context() as patch:
        patch.setattr(seal_days, "heads", lambda log: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            seal_days.run(spark, source, output)
    assert spark.read.parquet(f"{output}/marks").count() == 1
    assert rows_of(seal_days.run(spark, source, output)) == whole
    odd = events(spark, (1,)).where("event_id < 3").withColumn("props", F.try_element_at(F.array(F.lit(None), F.lit("no {json"), F.lit("[1, 2]")), (F.col("event_id") + 1).cast("int"))).withColumn("user_id", F.lit(None).cast("bigint"))
    odd.write.parquet(str(tmp_path / "odd"))
    sealed = seal_days.run(spark, str(tmp_path / "odd"), str(tmp_path / "odd_log")).orderBy("seq").collect()
    assert [(r.log_id, json.loads(r.details)["props"]) for r in sealed] == [("", None), ("", "no {json"), ("", [1, 2])]
    empty = events(spark, (1,)).where("false")
    empty.write.parquet(str(tmp_path / "none"))
    assert seal_days.run(spark, str(tmp_path / "none"), str(tmp_path / "nothing")).count() == 0
    # nothing is set in the session
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_command_line(tmp_path, monkeypatch):
    class Session:
        class builder:
            appName = staticmethod(lambda name: Session.builder)
            getOrCreate = staticmethod(lambda: Session())

        def stop(self):
            seen.append("stopped")

    from jobs import common

    seen = []
    monkeypatch.setattr(common, "SparkSession", Session)
    (tmp_path / "c.json").write_text('{"salt": "s"}')
    command_line("x", lambda spark, **given: seen.append(given), {"source": "s", "output": "o"}, {"through": "t"}, ["--source", "a", "--output", "b", "--config", str(tmp_path / "c.json")])
    assert seen == [{"config": {"salt": "s"}, "source": "a", "output": "b", "through": None}, "stopped"]
    for module, name in ((index_documents, "index_documents"), (seal_days, "seal_days")):
        config = json.load(open(os.path.join(os.path.dirname(module.__file__), f"{name}.json")))
        assert with_defaults(config, module.DEFAULTS) == module.DEFAULTS | config


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_job_queries(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = queries.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    found = con.execute(queries.oracle_sql()[name])
    place = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(tuple(norm(r[c]) for c in columns) for r in frame.collect()) == sorted(tuple(norm(r[i]) for i in place) for r in found.fetchall())


def test_seal_days_makes_details_once(spark, tmp_path):
    """Details are made once, behind the shuffle that numbers events; they are hashed and verified as they are stored."""
    before = spark.createDataFrame([], seal_days.HEADS)
    records = seal_days.records_of(events(spark, (1,)), before, seal_days.DEFAULTS)
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = plan(audit.seal(records, before, ready=True))
    assert made.count("ArrowEvalPython") == 1 and made.index("ArrowEvalPython") < made.index("Window")  # what comes later stands first
    source, output = str(tmp_path / "events"), str(tmp_path / "log")
    events(spark, (1, 2)).write.parquet(source)
    seal_days.run(spark, source, output)
    log = spark.read.parquet(f"{output}/records").drop("day")
    assert "ArrowEvalPython" not in plan(audit.verify(log, ready=True))
    assert all(r.ok for r in audit.verify(log, ready=True).collect()) and all(r.ok for r in audit.verify(log).collect())
    other = log.withColumn("details", F.when(F.col("request_id") == "1", F.concat(F.lit(" "), "details")).otherwise(F.col("details")))
    assert [(r.log_id, r.reason) for r in audit.verify(other, ready=True).where("not ok").collect()] == [("1", "record_hash mismatch")]
