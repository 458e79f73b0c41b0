"""Tables appended batch by batch, where a replayed batch replaces its own rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhour.operators.joins import BROADCAST_ROWS
from tallyhour.operators.rollup import measures, merge
from tallyhour.schemas import TALLY, ddl
from tallyhour.sinks.identity import stream_of
from tallyhour.sinks.versions import names


@dataclass(frozen=True)
class BatchTable:
    """Parquet below ``path``, a folder for each stream and in it one per ``batch_id``.

    Batch ids start at 0 with every checkpoint, so a batch is known by both: a second stream, or a
    checkpoint begun anew, adds folders and replaces none of another's.
    ``path`` must be on storage all executors share. A batch is written as it leaves the
    rollup's shuffle, whose partitions adaptive execution has merged to file size.
    """

    path: str
    columns: dict[str, str]

    def write(self, rows: DataFrame, batch_id: int, stream_id: str | None = None) -> None:
        """Write a batch of the running stream, or of the one named."""
        folder = f"{self.path}/stream_id={stream_id or stream_of(rows.sparkSession)}/batch_id={batch_id}"
        rows.select(*self.columns).write.mode("overwrite").parquet(folder)

    def finished(self, spark: SparkSession) -> dict[str, int]:
        """The newest batch of each stream that was written to its end. A stream's earlier ones are final."""
        newest = {}
        for stream in (name for name in names(spark, self.path) if name.startswith("stream_id=")):
            folders = [name for name in names(spark, f"{self.path}/{stream}") if name.startswith("batch_id=")]
            for batch in sorted((int(name.removeprefix("batch_id=")) for name in folders), reverse=True):
                if "_SUCCESS" in names(spark, f"{self.path}/{stream}/batch_id={batch}"):
                    newest[stream.removeprefix("stream_id=")] = batch
                    break
        return newest

    def read(self, spark: SparkSession) -> DataFrame:
        """All batches, with their ``stream_id`` and ``batch_id``; an empty frame before the first."""
        schema = ddl({**self.columns, "stream_id": "string", "batch_id": "bigint"})
        try:
            return spark.read.schema(schema).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)


def tally_table(path: str) -> BatchTable:
    return BatchTable(path, TALLY)


def published(spark: SparkSession, tallies: BatchTable) -> DataFrame:
    """Measures of every hour key over all batches so far."""
    return measures(merge(tallies.read(spark)))


def compact(spark: SparkSession, tallies: BatchTable, path: str, since_batch: int | Mapping[str, int] = 0) -> None:
    """Rewrite, in the table at ``path``, the dates touched from ``since_batch`` on.

    Batch ids count within a stream: for a table of several streams ``since_batch`` maps each stream to its first batch,
    and streams it does not name are taken whole; a number above 0 is refused there.

    Each touched date is rebuilt from all of its tallies and replaced as a whole, so a
    repeated or interrupted run ends in the same table. The touched range is two literals,
    pushed to the scan: a live batch covers few dates, so the files of others are skipped.
    The rebalance keeps the write from making a file per task and date, and lets adaptive
    execution split a date that holds most of the rows.
    """
    every = tallies.read(spark)
    if not isinstance(since_batch, Mapping):
        streams = [name.removeprefix("stream_id=") for name in names(spark, tallies.path) if name.startswith("stream_id=")]
        if since_batch and len(streams) > 1:
            raise ValueError("several streams have written this table; name the first batch of each")
        since_batch = dict.fromkeys(streams, since_batch)
    before = F.lit(False)
    for stream, batch in since_batch.items():
        before = before | ((F.col("stream_id") == stream) & (F.col("batch_id") < batch))
    touched = every.where(~before).select(F.col("dates").alias("touched")).distinct()
    # as text: a saturated timestamp has a date beyond what Python can hold
    *span, n_dates = touched.agg(
        F.min("touched").cast("string"), F.max("touched").cast("string"), F.count(F.lit(1))
    ).first()
    first, last = (F.lit(bound).cast("date") for bound in span)
    if n_dates <= BROADCAST_ROWS:
        touched = F.broadcast(touched)
    stale = every.where(F.col("dates").between(first, last) | F.col("dates").isNull()).join(
        touched, F.col("dates").eqNullSafe(F.col("touched")), "left_semi"
    )
    (
        measures(merge(stale))
        .hint("rebalance", "dates")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dates")
        .parquet(path)
    )
