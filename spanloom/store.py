"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go when a query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of tables that ``materialise`` has written in the current thread or run, and that are still there.
_RUN: ContextVar[list[str]] = ContextVar("run")


def _run() -> list[str]:
    found = _RUN.get(None)
    if found is None:
        _RUN.set(found := [])
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only in local mode (tests) a new temporary one, where that is unset."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        set_dir = sc._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            path = set_dir.get()
        elif sc.master.startswith("local"):
            path = "file://" + tempfile.mkdtemp(prefix="spanloom-")
            sc.setCheckpointDir(path)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


@contextmanager
def tables_of_run() -> Iterator[list[str]]:
    """What ``materialise`` writes inside this block, by this thread alone: the paths of tables that are still there."""
    before = _RUN.set([])
    try:
        yield _run()
    finally:
        _RUN.reset(before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it as read back.

    Unlike localCheckpoint the rows outlive the executors that made them. Files that were shuffled on the way are
    no longer needed then, and are removed at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    _run().append(path)
    return spark.read.schema(df.schema).parquet(path)


def last_table() -> str:
    """The path of the table that this thread wrote last."""
    return _run()[-1]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables of a run. For when nothing that reads them is still to run."""
    for path in list(paths):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system; a stopped session is left alone."""
    if path in _run():
        _run().remove(path)
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    try:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have gone before the interpreter's exit
        return
