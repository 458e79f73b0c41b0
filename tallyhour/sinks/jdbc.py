"""Appending fact rows over JDBC.

Spark commits each partition in a transaction of its own, so a failed append may leave
some partitions behind. ``append_once`` makes the replay of such a batch write only what
is missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhour.schemas import HOUR_KEYS
from tallyhour.sinks.identity import stream_of


def jdbc_append(rows: DataFrame, connection: dict[str, str], table: str = "events", connections: int = 8) -> None:
    """Append rows; ids and other columns not written come from the table's defaults.

    ``connections`` bounds the parallel writers. The rows are dealt out to them by a shuffle; left to the
    writer, the bound would also hold for the aggregate and the join before it.
    """
    (
        rows.repartition(connections).write.format("jdbc")
        .options(**connection)
        .option("dbtable", table)
        .option("numPartitions", connections)
        .mode("append")
        .save()
    )


def jdbc_batch_keys(
    spark: SparkSession, connection: dict[str, str], table: str, stream_id: str, batch_id: int, connections: int = 8
) -> DataFrame:
    """Hour keys the target already holds for a batch; an index on both ids serves it.

    They are read by as many connections as write, split by hour of the day; keys without an hour come with the first.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", stream_id):
        raise ValueError(f"not a stream id: {stream_id!r}")
    query = (
        f"SELECT {', '.join(HOUR_KEYS)} FROM {table} "
        f"WHERE stream_id = '{stream_id}' AND batch_id = {int(batch_id)}"
    )
    split = {"partitionColumn": "hours", "lowerBound": 0, "upperBound": 24, "numPartitions": connections}
    return spark.read.format("jdbc").options(**connection).option("dbtable", f"({query}) stored").options(**split).load()


def missing_rows(rows: DataFrame, stored_keys: DataFrame) -> DataFrame:
    """Rows whose hour key is not stored yet; dates and hours may be NULL on both sides."""
    stored = stored_keys.select([F.col(name).alias(f"stored_{name}") for name in HOUR_KEYS])
    same = [F.col(name).cast("string").eqNullSafe(F.col(f"stored_{name}").cast("string")) for name in HOUR_KEYS]
    return rows.join(stored, same, "left_anti")


def append_once(
    rows: DataFrame,
    batch_id: int,
    stored_keys: Callable[[str, int], DataFrame],
    append: Callable[[DataFrame], None],
    stream_id: str | None = None,
) -> None:
    """Append a batch so that repeating it adds nothing.

    The target carries ``stream_id`` and ``batch_id``: batch ids alone start anew with every checkpoint.
    A first attempt finds no stored key and appends at once; a replay leaves out the keys
    that earlier, committed partitions have stored. The stream is the running one unless named.
    """
    stream = stream_id or stream_of(rows.sparkSession)
    tagged = rows.withColumns({"stream_id": F.lit(stream), "batch_id": F.lit(batch_id).cast("bigint")})
    stored = stored_keys(stream, batch_id)
    append(tagged if stored.isEmpty() else missing_rows(tagged, stored))


def jdbc_sink(
    connection: dict[str, str],
    table: str = "events",
    connections: int = 8,
    dates_as_text: bool = False,
) -> Callable[[DataFrame, int], None]:
    """A micro-batch sink over JDBC; its rows are appended once however often they replay."""

    def write(rows: DataFrame, batch_id: int) -> None:
        append_once(
            _dates(rows, dates_as_text),
            batch_id,
            lambda stream, batch: jdbc_batch_keys(rows.sparkSession, connection, table, stream, batch, connections),
            lambda chosen: jdbc_append(chosen, connection, table, connections),
        )

    return write


def jdbc_plain_sink(
    connection: dict[str, str],
    table: str = "events",
    connections: int = 8,
    dates_as_text: bool = False,
) -> Callable[[DataFrame, int], None]:
    """A micro-batch sink for a target without ids of batches: a replay appends again."""
    return lambda rows, batch_id: jdbc_append(_dates(rows, dates_as_text), connection, table, connections)


def _dates(rows: DataFrame, as_text: bool) -> DataFrame:
    return rows.withColumn("dates", F.col("dates").cast("string")) if as_text else rows
