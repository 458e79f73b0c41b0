"""Which stream a micro-batch belongs to."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Identity of batches written outside a stream.
NO_STREAM = "batch"


def stream_of(spark: SparkSession) -> str:
    """The id of the running query, kept in its checkpoint: the same after a restart, new with a new checkpoint.

    Spark sets it for the thread that runs the batch.
    """
    found = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or NO_STREAM
    if not re.fullmatch(r"[A-Za-z0-9_-]+", found):
        raise ValueError(f"not a stream id: {found!r}")
    return found
