"""Intermediate tables in the folder that driver and executors share.

Long plans are cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it back, so a lost executor costs at most one stage.  Only a local session that
names no folder gets one of its own; on a cluster that is an error, since executors
would write where the others cannot read.  Tables go when their ``scope`` ends, and
otherwise when the driver's JVM does.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

Tables = list[tuple[SparkSession, str]]

_SCOPE: ContextVar[Tables] = ContextVar("scratch tables", default=[])  # noqa: B039 - the process-wide scope


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="barloom-shared-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def _store(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_path(spark: SparkSession, name: str, scope: Tables | None = None) -> str:
    """A path that nothing uses; its folder is made, and deleted with the scope or the JVM."""
    path = f"{shared_dir(spark)}/barloom-{name}-{uuid.uuid4().hex[:12]}"
    store, target = _store(spark, path)
    store.mkdirs(target)
    store.deleteOnExit(target)
    (_SCOPE.get() if scope is None else scope).append((spark, path))
    return path


def write(df: DataFrame, name: str, scope: Tables | None = None) -> DataFrame:
    """Write ``df`` once and return the table that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name, scope)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[Tables]:
    """Delete the tables written inside at the end, but those written with ``scope`` the value yielded, the one around."""
    around, own = _SCOPE.get(), []
    token = _SCOPE.set(own)
    try:
        yield around
    finally:
        _SCOPE.reset(token)
        release(own)


def release(tables: Tables | None = None) -> None:
    """Delete scratch tables (by default those of the present scope); call when their readers are done."""
    tables = _SCOPE.get() if tables is None else tables
    while tables:
        spark, path = tables.pop()
        if spark.sparkContext._jsc is not None:  # else its JVM deletes them
            store, target = _store(spark, path)
            store.delete(target, True)
            store.cancelDeleteOnExit(target)


#: Spark's own default for the bytes of an Arrow batch, and ours: batches wait in the JVM
#: and in the worker, and the kernels cut them into slices of a few megabytes anyway.
_BATCH, _DEFAULT_BATCH, _OUR_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(4 << 20)


def on_workers(spark: SparkSession) -> None:
    """Prepare for Python workers: small Arrow batches, and this package on their path.

    A batch size that the user chose stays.  On a cluster the package is shipped with
    ``--py-files``; the path only covers workers that share the driver's file system.
    """
    if spark.conf.get(_BATCH, _OUR_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH, _OUR_BATCH)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
