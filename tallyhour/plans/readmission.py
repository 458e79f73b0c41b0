"""Refused rows taken back once the dimension knows their keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhour.operators.integrity import Reference, accepted, mark_all, rejected
from tallyhour.schemas import ddl
from tallyhour.session import scratch
from tallyhour.sinks.batches import BatchTable
from tallyhour.sinks.compaction import later
from tallyhour.sinks.versions import Versions

#: Stream under which readmitted rows are stored among the facts; their batch is the pass.
READMITTED = "readmitted"


def _state(spark: SparkSession, path: str) -> tuple[int, dict]:
    return Versions(f"{path}/passes").newest(spark)


def still_refused(spark: SparkSession, quarantine: BatchTable, path: str) -> DataFrame:
    """Rows in quarantine: what the last pass left, and the batches refused since."""
    _, record = _state(spark, path)
    fresh = later(quarantine.read(spark), record.get("covered", {})).select(*quarantine.columns)
    if not record:
        return fresh
    left = spark.read.schema(ddl(quarantine.columns)).parquet(f"{path}/left/{record['left']}")
    return left.unionByName(fresh)


def readmit(
    spark: SparkSession,
    quarantine: BatchTable,
    path: str,
    facts: BatchTable,
    references: list[Reference],
    before_switch: Callable[[], None] | None = None,
) -> int:
    """Judge all refused rows anew and move those that pass to the facts; the number of this pass.

    A pass is known by its number. It writes the accepted rows as that batch of the facts, what is left to a
    folder of its own, and then its record, which also says up to which batch of each stream it has judged. Cut short
    before the record, the next call has the same number and replaces the same batch, so a row is in the facts once
    however often that happens. One program at a time may run passes; a second one is refused at the record.
    """
    number, record = _state(spark, path)
    number += 1
    covered = {**record.get("covered", {}), **quarantine.finished(spark)}
    pending = still_refused(spark, quarantine, path)
    carried = {name for reference in references for name in reference.carry}
    marked = mark_all(pending.drop("failed_reference", *carried), references)
    landing = scratch(spark, "readmission")
    marked.write.parquet(landing)
    landed = spark.read.schema(marked.schema).parquet(landing)
    back = accepted(landed, *references).withColumn("updated_at", F.current_timestamp())
    facts.write(back, number, READMITTED)
    left = uuid.uuid4().hex
    rejected(landed, *references).select(*quarantine.columns).write.parquet(f"{path}/left/{left}")
    if before_switch:
        before_switch()
    Versions(f"{path}/passes").add(spark, number, {"covered": covered, "left": left})
    return number
