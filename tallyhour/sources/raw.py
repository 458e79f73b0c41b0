"""The raw tracking table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhour.schemas import TRACKING, ddl

_FILES = frozenset({"parquet", "orc", "json", "csv", "avro"})


def raw_table(spark: SparkSession, format: str, options: dict[str, str]) -> DataFrame:
    """The tracking columns of a table in any store Spark has a connector for.

    Bounds on ``ts`` and the column list are pushed to the connector; the connector's
    own splits decide how many tasks read.
    """
    return spark.read.format(format).options(**options).load().select(*TRACKING)


def raw_stream(spark: SparkSession, format: str, options: dict[str, str]) -> DataFrame:
    """The raw table as a stream of its new rows, from a connector that can give one; a stream of files needs its columns told."""
    reader = spark.readStream.format(format).options(**options)
    return (reader.schema(ddl(TRACKING)) if format in _FILES else reader).load().select(*TRACKING)
