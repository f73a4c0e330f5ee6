"""What several operators of this folder share: table access, labelled samples, worker caches."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow record batch that are worked on together; bounds a worker's memory.
SLICE = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, read through Spark, so that ``folder`` may be in any store."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: Column, divisor: int) -> Column:
    """``crc32(key as text) mod divisor``; NULL for a NULL key."""
    return F.crc32(key.cast("string")) % divisor


def sample_per_class(df: DataFrame, label: str, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of each value of ``label``, or all where there are fewer.

    A row is taken if its key hashes under the class's share, so the sample does not depend
    on order or partitioning, its size is bounded in expectation, and only the classes'
    counts are gathered. Rows with a NULL label or key are left out.
    """
    known = df.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = known.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row per class of a classifier, so small enough to broadcast
    return known.join(F.broadcast(counts), F.col(label) == F.col("_label")).where(share * F.col("_n") < rows).drop("_label", "_n")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def worker_cache(slot: str, key: object, make: Callable[[], object]) -> object:
    """``make()``, once per Python worker process and (slot, key); a worker keeps the latest only.

    Functions are shipped to the workers by value, so their module globals live for one
    task only. What is costly to load (a vocabulary, a bounded memo) is hung on a module
    object that lives as long as the worker.
    """
    home = sys.modules.setdefault("_worker_cache", ModuleType("_worker_cache")).__dict__
    if home.get("held") != (slot, key):
        home.pop("value", None)  # before the next is made: one operator's memos at a time
        home["value"], home["held"] = make(), (slot, key)
    return home["value"]


def free_worker() -> None:
    """Give back what :func:`worker_cache` keeps in this worker, for an operator that needs none of it.

    Workers are used again by later stages; the C library is asked to return freed memory to the system.
    """
    home = sys.modules.get("_worker_cache")
    if home is not None and home.__dict__.pop("value", None) is not None:
        home.__dict__["held"] = None
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def broadcast(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast ``value``; the function returned reads it in a worker.

    It travels as bytes that hold its classes too, so a worker need not have this package.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def slices(batches: Iterable, rows: int = SLICE) -> Iterator:
    """The record batches cut into slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
