"""Batches of a tally table merged into a table by date, while streams go on writing.

The record of the compacted table notes for each stream up to which batch it holds it. Readers take the
compacted dates and add only later batches, so no tally is counted twice or missed, whenever a compaction
stops. State columns are kept, so averages can be added to for ever.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhour.operators.rollup import measures, merge
from tallyhour.schemas import TALLY
from tallyhour.sinks.batches import BatchTable
from tallyhour.sinks.dated import DatedTable, Snapshot, dates_of
from tallyhour.sinks.versions import names, remove

_COVERED = "covered"


def compacted_table(path: str) -> DatedTable:
    return DatedTable(path, TALLY)


def _covered(snapshot: Snapshot) -> dict[str, int]:
    return snapshot.notes.get(_COVERED, {})


def later(batches: DataFrame, covered: dict[str, int]) -> DataFrame:
    """Batches of each stream after the one covered; both are folder names, so others are not listed for reading."""
    done = F.lit(False)
    for stream, batch in sorted(covered.items()):
        done = done | ((F.col("stream_id") == stream) & (F.col("batch_id") <= batch))
    return batches.where(~done)


def compact_batches(
    spark: SparkSession, tallies: BatchTable, table: DatedTable, before_switch: Callable[[], None] | None = None
) -> Snapshot:
    """Merge all finished batches the table does not hold yet; only the dates they touch are copied."""
    seen = table.snapshot(spark)
    covered, finished = _covered(seen), tallies.finished(spark)
    ahead = {stream: batch for stream, batch in finished.items() if batch > covered.get(stream, -1)}
    if not ahead:
        return seen
    within = F.lit(False)
    for stream, batch in sorted(ahead.items()):
        within = within | ((F.col("stream_id") == stream) & (F.col("batch_id") <= batch))
    fresh = later(tallies.read(spark).where(within), covered).select(*TALLY)
    dates = dates_of(fresh)
    rows = merge(table.read(spark, seen, dates).unionByName(fresh))
    return table.replace(rows, seen, notes={**seen.notes, _COVERED: {**covered, **ahead}}, before_switch=before_switch)


def served(spark: SparkSession, tallies: BatchTable, table: DatedTable) -> DataFrame:
    """Measures of every hour key: compacted dates and the batches since, merged on read."""
    seen = table.snapshot(spark)
    fresh = later(tallies.read(spark), _covered(seen)).select(*TALLY)
    return measures(merge(table.read(spark, seen).unionByName(fresh)))


def expire_batches(spark: SparkSession, tallies: BatchTable, table: DatedTable) -> int:
    """Remove the batches that the record before the newest covers; how many went.

    One record is left as grace for readers that have begun with it. The newest batch of a stream always stays: a
    restart may repeat it.
    """
    numbers = table._versions().numbers(spark)
    if len(numbers) < 2:
        return 0
    covered = table._versions().record(spark, numbers[-2])["notes"].get(_COVERED, {})
    removed = 0
    for stream, batch in covered.items():
        folder = f"{tallies.path}/stream_id={stream}"
        held = sorted(int(name.removeprefix("batch_id=")) for name in names(spark, folder) if name.startswith("batch_id="))
        for one in held[:-1]:
            if one <= batch:
                remove(spark, f"{folder}/batch_id={one}")
                removed += 1
    return removed
