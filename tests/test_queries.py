import math

import duckdb
import pytest

from tessera.plans import oracles, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    try:
        return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    frame = registry.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in frame.collect())
    if name in oracles.oracle_sql():
        found = duck.execute(oracles.oracle_sql()[name])
        place = [[d[0] for d in found.description].index(c) for c in columns]
        assert got == sorted(tuple(norm(r[i]) for i in place) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


NAMES = ["seen by Mary Smith John Brown and Alan Turing Grace Hopper Ada Byron.", "by Alan  Turing Bob", "x Mary Smithé", "a Patient Room b Kim Lee Tom Ray", "met Al Li, met Ann Lee_x, then Ann Lee", "é Mary Smith", "Dr. Ann Lee told Eve Fox; DOB: Ann Lee, 12345", "tell\tAnn\nLee", "iAnn Lee", None, ""]


def test_names_by_two_capitals(spark, tmp_path):
    """The SQL that stands in for look-behind, on names in a row, in other scripts and with odd blanks."""
    rows = list(enumerate(NAMES))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.doc_id: r.types for r in registry.pii_default_types(spark, str(tmp_path)).collect()}
    assert got == dict(con.execute("SELECT doc_id, types FROM (" + oracles.oracle_sql()["pii_default_types"] + ")").fetchall())
    assert got[0] == "PERSON=5" and got[9] == got[10] == ""
