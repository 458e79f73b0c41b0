"""Dimension tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhour.operators.joins import unique
from tallyhour.schemas import JOB, ddl
from tallyhour.sinks.versions import remove

JOB_QUERY = f"SELECT {', '.join(JOB)} FROM job"


def jdbc_options(connection: dict[str, str], query: str = JOB_QUERY) -> dict[str, str]:
    """Reader options: the caller's connection plus the subquery to read."""
    if "dbtable" in connection or "query" in connection:
        raise ValueError("name the table through the query argument")
    return {**connection, "query": query}


def jdbc_dimension(spark: SparkSession, connection: dict[str, str], query: str = JOB_QUERY) -> DataFrame:
    """A dimension read over JDBC; filters and unused columns stay in the database.

    ``connection`` holds ``url``, ``driver``, ``user`` and ``password``. One connection
    reads the whole result. A dimension too large for that is read by ``jdbc_table``.
    """
    return spark.read.format("jdbc").options(**jdbc_options(connection, query)).load()


def jdbc_table(
    spark: SparkSession,
    connection: dict[str, str],
    table: str,
    key: str,
    bounds: tuple[int, int],
    partitions: int,
) -> DataFrame:
    """A large table read by ``partitions`` connections, split on a numeric key."""
    lower, upper = bounds
    return (
        spark.read.format("jdbc")
        .options(**connection)
        .option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )


def stored_dimension(spark: SparkSession, path: str, columns: dict[str, str] = JOB, key: str | None = None) -> DataFrame:
    """A dimension kept as parquet, read by its declared columns; its first column, or ``key``, must be unique.

    Call again for each micro-batch: a frame lists its files only once.
    """
    found = spark.read.schema(ddl(columns)).parquet(path).select(*columns)
    return unique(found, key or next(iter(columns)))


def jdbc_bounds(spark: SparkSession, connection: dict[str, str], table: str, key: str) -> tuple[int, int]:
    """Least and greatest key of a table, worked out by the database; (0, 0) of an empty one."""
    query = f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}"
    row = spark.read.format("jdbc").options(**jdbc_options(connection, query)).load().first()
    return (row[0] or 0, row[1] or 0)


def refreshed(
    load: Callable[[], DataFrame], path: str, seconds: float, clock: Callable[[], float] = time.monotonic
) -> Callable[[], DataFrame]:
    """A loader that reads the source once per ``seconds`` and serves batches from a copy below ``path``.

    The copy is parquet on shared storage: its size is known without counting it, so Spark decides on a broadcast by
    itself, and a lost executor does not go back to the source. A batch under way keeps the copy it began with: only the one
    before the last is removed. With 0 seconds every call reads anew.
    """
    state: dict = {"read_at": None, "copies": []}

    def loaded() -> DataFrame:
        now = clock()
        if state["read_at"] is None or now - state["read_at"] >= seconds:
            found = load()
            copy = f"{path}/copy-{uuid.uuid4().hex}"
            found.write.parquet(copy)
            state.update(read_at=now, schema=found.schema, copies=[*state["copies"], copy])
            for old in state["copies"][:-2]:
                remove(found.sparkSession, old)
            state["copies"] = state["copies"][-2:]
            state["spark"] = found.sparkSession
        return state["spark"].read.schema(state["schema"]).parquet(state["copies"][-1])

    return loaded
