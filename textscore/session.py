"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
DROP_SHUFFLES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "textscore") -> SparkSession:
    """A session for tests and benchmarks on one machine.

    On a cluster, use the session the cluster gives; the library only relies on
    AQE (skew join, coalescing, run-time broadcast), which is on by default.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # at run time, hash instead of sorting where every partition is seen to be small
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, created on first use where it is unset.

    Outside local mode an unset folder becomes a sub-folder of the warehouse; a warehouse on
    a machine's own disk raises. A machine-local folder is only made in local mode.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY) or sc.getCheckpointDir()
    if not named:
        if sc.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="textscore-ckpt-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_textscore_checkpoints"
            if _scheme(spark, named) == "file":
                raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share; {named} is local to a machine")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _scheme(spark: SparkSession, path: str) -> str:
    return _hadoop_path(spark, path)[1].getUri().getScheme()


def _hadoop_path(spark: SparkSession, path: str):
    """(path, its file system), for stores that Python cannot open."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named, named.getFileSystem(spark._jsc.hadoopConfiguration())


#: Folders written by ``store`` and not released yet.
_STORED: list[str] = []


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session with another value of a setting inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def store(df: DataFrame, label: str, once: bool = False) -> DataFrame:
    """``df`` as a table written to the shared folder: computed once, read by what follows.

    The table stays until ``release`` or the end of a ``stored_tables`` block, since a result
    that reads it may be evaluated at any later time. With ``once``, what was shuffled for it leaves
    the disks as soon as it is written, not when the driver next collects its garbage.
    """
    path = work_path(df.sparkSession, label)
    with _setting(df.sparkSession, DROP_SHUFFLES_KEY, "true") if once else nullcontext():
        df.write.parquet(path)
    _STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``store`` has written, all or those after the first ``since``.

    Call it once the results that were built on them are written or collected.
    """
    while len(_STORED) > since:
        path, files = _hadoop_path(spark, _STORED.pop())
        files.delete(path, True)


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast ``value``, whose size the caller has bounded; the function returned reads it in a worker.

    It travels as bytes that hold its classes too, so a worker need not have this package.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables stored inside the block are deleted at its end."""
    since = len(_STORED)
    try:
        yield
    finally:
        release(spark, since)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    Used where a later stage must see exactly the same rows again after a lost
    executor (for instance sketch-based split points), never for speed alone.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
