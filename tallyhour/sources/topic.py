"""Topic of change messages as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhour.schemas import ddl

MESSAGE = {"value": "binary"}


def topic_stream(spark: SparkSession, options: dict[str, str], format: str = "kafka") -> DataFrame:
    """Message values of a topic from its beginning.

    For ``kafka`` pass ``kafka.bootstrap.servers`` and ``subscribe``; add
    ``maxOffsetsPerTrigger`` so that the first batch of a long topic has a bounded size,
    and ``minPartitions`` to read a few hot topic partitions with more tasks. Any other
    format is a file stream with a binary ``value`` column below ``path``.
    """
    reader = spark.readStream.format(format)
    if format == "kafka":
        reader = reader.option("startingOffsets", "earliest")
    else:
        reader = reader.schema(ddl(MESSAGE))
    return reader.options(**options).load().select("value")
