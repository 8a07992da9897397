"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master, where all threads share one disk, gets a folder of its own when none is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints/spanloom")
    return sc.getCheckpointDir().rstrip("/")


#: Folders of the open scratch() blocks of each thread, innermost last.
_scratch = threading.local()
#: Bounds of a batch that goes to Python, so that a task's memory does not grow with the length of texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def _open_folders() -> list[str]:
    if not hasattr(_scratch, "folders"):
        _scratch.folders = []
    return _scratch.folders


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{_open_folders()[-1] if _open_folders() else shared_dir(spark)}/spanloom-{tag}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, tag: str) -> Iterator[None]:
    """What new_folder and materialize write inside is removed at the end: nothing that is read later may rest on it."""
    folder = new_folder(spark, tag)
    _open_folders().append(folder)
    try:
        yield
    finally:
        _open_folders().pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Sends texts to Python in batches of BATCH_ROWS rows or BATCH_BYTES bytes, or as the session says."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) in ("64MB", str(64 << 20)):  # Spark's own default
        spark.conf.set(size, str(BATCH_BYTES))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and return it as read back: later steps neither
    recompute it nor depend on an executor that may be lost."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with none of df's (Spark compares names without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
