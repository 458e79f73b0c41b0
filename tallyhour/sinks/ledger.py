"""Rows already sent, for scans that reach back over rows they have seen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhour.schemas import TRACKING
from tallyhour.sinks.versions import names, remove

_HOUR = 3600


def _row_hash() -> Column:
    return F.xxhash64(*[F.col(name) for name in TRACKING])


def _in_hour() -> Column:
    return F.floor(F.unix_seconds("ts") / _HOUR).cast("bigint")


@dataclass(frozen=True)
class SentLedger:
    """Keys of sent rows below ``path``, a folder for each hour of their ``ts``.

    A row is known by ``create_time`` and a hash of all its columns, so a row that was changed is sent again; a row
    without ``create_time`` by its hash alone. Only hours that a later scan may reach are kept: what the ledger holds
    grows with the overlap and not with the table.
    """

    path: str

    def hours(self, spark: SparkSession) -> list[int]:
        found = [name.removeprefix("hour=") for name in names(spark, f"{self.path}/sent") if name.startswith("hour=")]
        return sorted(int(hour) for hour in found)

    def keys(self, rows: DataFrame) -> DataFrame:
        return rows.select("create_time", _row_hash().alias("row_hash"), _in_hour().alias("hour"))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("create_time string, row_hash bigint, hour bigint").parquet(f"{self.path}/sent")

    def unsent(self, scan: DataFrame) -> DataFrame:
        """The rows of a scan that the ledger does not hold.

        Only rows of the hours it covers are compared; the rest pass without a shuffle. Both bounds reach the scan.
        """
        spark = scan.sparkSession
        hours = self.hours(spark)
        if not hours:
            return scan
        first, after = (F.timestamp_seconds(F.lit(hour * _HOUR)) for hour in (hours[0], hours[-1] + 1))
        compared = scan.where((F.col("ts") >= first) & (F.col("ts") < after))
        sent = self.read(spark).select(*[F.col(name).alias(f"sent_{name}") for name in ("create_time", "row_hash", "hour")])
        same = (
            F.col("create_time").eqNullSafe(F.col("sent_create_time"))
            & (_row_hash() == F.col("sent_row_hash"))
            & (_in_hour() == F.col("sent_hour"))
        )
        left = compared.join(sent, same, "left_anti")
        return scan.where(F.col("ts") < first).unionByName(left).unionByName(scan.where(F.col("ts") >= after))

    def landed(self, rows: DataFrame) -> DataFrame:
        """Rows written down, so that those that are sent are those that are recorded."""
        path = f"{self.path}/landing"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def add(self, rows: DataFrame) -> None:
        """Record rows as sent. Cut short, some of them may be sent again, and none is lost."""
        self.keys(rows).hint("rebalance", "hour").write.mode("append").partitionBy("hour").parquet(f"{self.path}/sent")

    def expire(self, spark: SparkSession, before: int) -> None:
        """Drop the hours that end before this epoch second."""
        for hour in self.hours(spark):
            if (hour + 1) * _HOUR <= before:
                remove(spark, f"{self.path}/sent/hour={hour}")
