"""Rollup of a change topic, one tally per micro-batch."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallyhour.operators.dedup import KEY, distinct_stream
from tallyhour.operators.envelope import dead_letters, living, read_changes, read_or_refuse
from tallyhour.operators.rollup import tally
from tallyhour.plans.batch import BatchSink
from tallyhour.schemas import ROLLUP_FIELDS


def changes_of(topic: DataFrame, dedup_horizon: str | None = None, keep_dead: bool = False) -> DataFrame:
    """The rollup's columns of each change; copies within ``dedup_horizon`` dropped, dead letters kept if asked for."""
    read = read_or_refuse if keep_dead else read_changes
    if not dedup_horizon:
        return read(topic, ROLLUP_FIELDS)
    return distinct_stream(read(topic, [KEY, *ROLLUP_FIELDS]), dedup_horizon)


def run_rollup(
    topic: DataFrame,
    sink: BatchSink,
    checkpoint: str,
    dedup_horizon: str | None = None,
    dead: BatchSink | None = None,
    landing: str | None = None,
    **trigger: Any,
) -> StreamingQuery:
    """Start the query; ``sink(tallies, batch_id)`` receives each batch that has rows.

    The tallies are not cached, which would also fix their number of partitions: a sink
    that needs them twice writes them down first, as ``deliver`` does. Only with
    ``dedup_horizon`` they are, so that a batch without rows is seen before it is written.

    No watermark guards the hours: an event of any age joins the batch it arrives in, and
    one hour key may appear in many batches. The checkpoint is mandatory, and an error in
    the sink stops the query, so a restart repeats that batch. The sink must therefore be
    safe to repeat, as the tables of ``tallyhour.sinks`` are. Without a trigger argument
    batches follow one another directly.

    With ``dead``, that sink receives the messages that gave no row, with the reason. Each batch is then parsed
    and written once to ``landing``, a folder of this query on shared storage, and both sinks read it there.
    """
    if dead and not landing:
        raise ValueError("dead letters need a landing folder")

    def apart(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(landing)
        landed = batch.sparkSession.read.schema(batch.schema).parquet(landing)
        letters, rows = dead_letters(landed), living(landed)
        if not letters.isEmpty():
            dead(letters, batch_id)
        if not rows.isEmpty():
            sink(tally(rows), batch_id)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if not dedup_horizon:
            if not batch.isEmpty():
                sink(tally(batch), batch_id)
            return
        # looking into a deduplicated batch would run its state once more, so its tally is kept
        tallied = tally(batch).persist()
        try:
            if not tallied.isEmpty():
                sink(tallied, batch_id)
        finally:
            tallied.unpersist()

    writer = changes_of(topic, dedup_horizon, bool(dead)).writeStream.foreachBatch(apart if dead else on_batch)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.option("checkpointLocation", checkpoint).start()


def run_to_end(
    topic: DataFrame,
    sink: BatchSink,
    checkpoint: str,
    dedup_horizon: str | None = None,
    dead: BatchSink | None = None,
    landing: str | None = None,
) -> StreamingQuery:
    """Process what the topic holds now, then return the ended query."""
    query = run_rollup(topic, sink, checkpoint, dedup_horizon, dead, landing, availableNow=True)
    query.awaitTermination()
    return query
