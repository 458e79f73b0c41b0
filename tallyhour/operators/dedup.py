"""Redelivered changes, recognised by ``create_time``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "create_time"


def distinct_changes(changes: DataFrame) -> DataFrame:
    """One row per ``create_time``, the greatest of its copies; rows without a key all stay.

    An aggregate, not a window: copies collapse inside each map task, so a change sent
    a million times reaches the reducer once per task. The input is read and parsed once: rows
    without a key are grouped by a number of their own. Whole rows are compared, strings
    included, so Spark aggregates by sorting, on both sides of the shuffle.
    """
    others = [name for name in changes.columns if name != KEY]
    unkeyed = F.when(F.col(KEY).isNull(), F.monotonically_increasing_id())
    return (
        changes.withColumn("_unkeyed", unkeyed)
        .groupBy(KEY, "_unkeyed")
        .agg(F.max(F.struct(*others)).alias("row"))
        .select(KEY, "row.*")
        .select(*changes.columns)
    )


def conflicting_changes(changes: DataFrame) -> DataFrame:
    """``create_time, n_copies`` of changes whose copies are not all alike, of which ``distinct_changes`` keeps one.

    Rows are told apart by 128 bits of hash: the aggregate's state is four numbers, hashed throughout without a sort.
    """
    columns = [F.col(name) for name in changes.columns]
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    hashed = changes.where(F.col(KEY).isNotNull()).select(KEY, one.alias("one"), two.alias("two"))
    ends = [f(name).alias(f"{end}_{name}") for name in ("one", "two") for end, f in (("low", F.min), ("high", F.max))]
    found = hashed.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_copies"), *ends)
    return found.where("low_one <> high_one or low_two <> high_two").select(KEY, "n_copies")


def distinct_stream(changes: DataFrame, horizon: str, salts: int = 16) -> DataFrame:
    """Drop copies that arrive within ``horizon`` of the first one, across micro-batches.

    The watermark runs on arrival time, which no row can be late for, so events with an
    old ``ts`` are kept. The first pass splits the copies of one change over ``salts``
    tasks by input partition; the second then meets at most that many.
    """
    arrived = (
        changes.withColumns(
            {
                "arrived_at": F.current_timestamp(),
                "change_key": F.coalesce(KEY, F.uuid()),
                "salt": F.pmod(F.spark_partition_id(), F.lit(salts)),
            }
        )
        .withWatermark("arrived_at", horizon)
        .dropDuplicatesWithinWatermark(["change_key", "salt"])
        .dropDuplicatesWithinWatermark(["change_key"])
    )
    return arrived.drop("arrived_at", "change_key", "salt")
