"""Helpers shared by the operators: tables, landed frames, lists of ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhour.session import scratch

#: Rows that come to no more than this are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16_000_000
#: What has been landed in the innermost block of ``passing``.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def land(frame: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """Write a frame below the shared folder and read it back, so that it is worked out once.

    A lost executor then costs a task and not the work before it. In blocks of ``passing``, ``stays`` lets the frame
    outlive them.
    """
    spark = frame.sparkSession
    path = scratch(spark, f"llm-{label}")
    passed = _PASSING.get()
    if passed is not None and not stays:
        passed.append(path)
    with shuffles_freed(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def in_slices(work: Callable[[DataFrame], DataFrame], rows: DataFrame, key: Column, slices: int, label: str) -> DataFrame:
    """What ``work`` makes of ``rows``, landed slice by slice of a whole number ``key``.

    The disk then holds the shuffles of one slice at a time. ``work`` must not need rows of different slices together.
    """
    if slices <= 1:
        return land(work(rows), label)
    return reduce(DataFrame.union, [land(work(rows.where(F.pmod(key, F.lit(slices)) == k)), label) for k in range(slices)])


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is landed while it lasts is deleted when it ends, but for what stays."""
    paths: list[str] = []
    token = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_freed(spark: SparkSession):
    """While it lasts, the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def checked(rows: DataFrame, n: int | None = None, row_bytes: int = 16) -> DataFrame:
    """A frame marked for broadcast only if a count proves it small; ``row_bytes`` is the most that a row may take."""
    if n is None:
        with shuffles_freed(rows.sparkSession):
            n = rows.count()
    return F.broadcast(rows) if n * row_bytes <= BROADCAST_BYTES else rows


def own(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns under the operator's names; other columns never meet them."""
    return frame.select(*[frame[f"`{theirs}`"].alias(ours) for ours, theirs in columns.items()])


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it lasts, Python workers get texts in batches of at most ``rows``, which bounds what the JVM holds beside its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if 0 < int(spark.conf.get(key)) <= rows:
        yield
        return
    with _set(spark, key, str(rows)):
        yield
