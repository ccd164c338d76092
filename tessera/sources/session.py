"""What a session needs before Python functions of this package run on its workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hands this package to the workers, once for each context, so that they can import it wherever they run; and bounds
    the batches they get, by rows and bytes, where the session has the defaults."""
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b")):
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    import tessera

    home = os.path.dirname(os.path.abspath(tessera.__file__))
    fd, path = tempfile.mkstemp(suffix="-tessera.zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.unlink(path))  # workers that start later still fetch it
    context._tessera_shipped = True


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that nothing has used, where driver and executors share files: under spark.checkpoint.dir, or a local one
    where none is set and all runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.gettempdir()}/tessera-folders"
    return f"{shared}/{name}-{uuid.uuid4().hex}"


_scratch: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """As new_folder, for what a result that isn't written yet is read from. It goes with the process, or before that when
    `without_scratch` ends."""
    folder = new_folder(spark, name)
    if not _scratch:
        atexit.register(_drop, spark, _scratch)
    _scratch.append(folder)
    return folder


def _drop(spark: SparkSession, folders: list[str]) -> None:
    while folders:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(folders.pop())
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may have gone already
            return


@contextmanager
def without_scratch(spark: SparkSession) -> Iterator[None]:
    """Drops the scratch folders that were made inside, whose results have been written by then."""
    before = set(_scratch)
    try:
        yield
    finally:
        made = [f for f in _scratch if f not in before]
        _scratch[:] = [f for f in _scratch if f in before]
        _drop(spark, made)
