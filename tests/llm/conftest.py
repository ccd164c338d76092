import pytest


@pytest.fixture(scope="session")
def table(spark):
    """A table from tuples; every row gets extra columns whose names clash with those of results."""

    def make(rows, schema):
        names = [c.split()[0] for c in schema.split(",")]
        extra = [c for c in ("score", "kept", "rid", "_text", "node", "component_id", "h", "i", "label", "lang", "uid", "dg", "z", "deal", "part", "_rid", "_raw", "b", "dim", "cell", "segment", "groups", "tail", "_toxic", "_features", "n_tokens", "asked") if c not in names]
        frame = spark.createDataFrame([tuple(r) for r in rows], schema)
        return frame.selectExpr("*", *[f"'x' AS {c}" for c in extra])

    return make
