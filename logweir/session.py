"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A JSON record that repeats a key keeps the last value, as log readers expect.
    "spark.sql.variant.allowDuplicateKeys": "true",
}
# The JVM never compiles a method of more than 8,000 bytes. Parsing a line is longer than that in one
# generated method, and faster in the many small ones that are made where a stage exceeds this limit.
# Arrow batches of long texts: at most 1 MB a batch (64 MB by default). A task holds a batch several times, in buffers of its JVM and in its Python worker.
SPEED = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.execution.arrow.maxBytesPerBatch": "1m"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings the package relies on; safe to call again."""
    for key, value in {**SETTINGS, **SPEED}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: what ``spark.checkpoint.dir`` names.

    Only a local-mode session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="logweir-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_taken: ContextVar[list[str] | None] = ContextVar("scratch paths", default=None)


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if _taken.get() is not None:
        _taken.get().append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch paths given out inside are removed at the end: what is made of them has to be written by then."""
    token = _taken.set([])
    try:
        yield
    finally:
        paths = _taken.get()
        _taken.reset(token)
        for path in paths:
            remove(spark, path)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as each ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_FREED)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there (cuts the lineage)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
