"""Shape of the rows written to the ``events`` fact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhour.schemas import EVENTS, EVENTS_DEFAULTS, EVENTS_WRITTEN
from tallyhour.session import scratch


def to_events_contract(enriched: DataFrame) -> DataFrame:
    """The written columns in order, then the load time."""
    return enriched.select(*EVENTS_WRITTEN).withColumn("updated_at", F.current_timestamp())


def with_table_defaults(rows: DataFrame) -> DataFrame:
    """Fill the columns the table would default, for targets that have no defaults."""
    missing = {name: F.expr(value) for name, value in EVENTS_DEFAULTS.items() if name not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def last_id(stored: DataFrame) -> int:
    """The greatest id of the rows stored so far: ``start`` of the next append."""
    return stored.agg(F.max("id")).first()[0] or 0


def with_ids(
    rows: DataFrame, order_by: list[str], start: int | Callable[[int], int] = 0, path: str | None = None
) -> DataFrame:
    """Dense ids from ``start + 1`` in the order of ``order_by``, which must be unique.

    ``start`` may be a function of the number of rows, such as one that reserves that many ids.

    Rows are range-partitioned and written once with their place inside the partition;
    the partition sizes then give each partition its offset. No task sees all rows: the
    offsets are one row per shuffle partition. The written copy fixes the range bounds,
    which a recomputation after a lost executor would draw anew; it lies at ``path``, if named, for
    the caller to remove.
    """
    spark = rows.sparkSession
    path = path or scratch(spark, "ids")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    (
        rows.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumns({"_part": F.spark_partition_id(), "_place": place})
        .write.parquet(path)
    )
    placed = spark.read.parquet(path)
    if callable(start):
        start = start(placed.count())
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("_part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    )
    numbered = placed.join(F.broadcast(offsets), "_part")
    new_id = F.lit(start) + F.col("offset") + F.col("_place") + F.lit(1)
    return numbered.select(new_id.cast("bigint").alias("id"), *rows.columns)


def events_rows(
    spark: SparkSession, contract: DataFrame, start: int | Callable[[int], int] = 0, path: str | None = None
) -> DataFrame:
    """All columns of the fact table, ids and defaults included; ids go on after ``start``."""
    order = ["job_id", "dates", "hours", "publisher_id", "campaign_id", "group_id"]
    return with_table_defaults(with_ids(contract, order, start, path)).select(*EVENTS)
