"""Change envelopes: raw rows to JSON messages and back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhour.functions import EPOCH, millis, op_code, saturating_instant
from tallyhour.schemas import TRACKING, change_ddl


def _wire(name: str) -> str:
    if name == "ts":
        return "unix_millis(`ts`)"
    if name == "bid":
        # widened, so the message carries the stored 32-bit value digit for digit
        return "CAST(CAST(`bid` AS float) AS double)"
    return f"CAST(`{name}` AS {TRACKING[name]})"


def to_envelope(tracking: DataFrame, cursor: str | datetime | Column = EPOCH) -> DataFrame:
    """One message per row: ``{payload: {after, op, ts_ms}}`` as UTF-8 in ``value``.

    Every field of the row is written, missing ones as JSON null.
    """
    fields = ", ".join(f"{_wire(name)} AS `{name}`" for name in TRACKING)
    payload = F.struct(
        F.expr(f"struct({fields})").alias("after"),
        op_code(cursor).alias("op"),
        millis(F.current_timestamp()).alias("ts_ms"),
    )
    message = F.to_json(F.struct(payload.alias("payload")), {"ignoreNullFields": "false"})
    return tracking.select(message.cast("binary").alias("value"))


def parse_envelope(messages: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The changed row of each message; unreadable messages give a row of NULLs.

    ``inline`` keeps later filters above the parse. Flattened by a projection instead, a
    filter on a field is pushed below it and every message is parsed twice.
    """
    change = F.from_json(F.col("value").cast("string"), change_ddl(fields))
    return messages.select(F.inline(F.array(change["payload"]["after"])))


def normalize_ts(changes: DataFrame) -> DataFrame:
    return changes.withColumn("ts", saturating_instant(F.col("ts")))


def read_changes(messages: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return normalize_ts(parse_envelope(messages, fields))


def read_or_refuse(messages: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The changed row of each message, as ``read_changes`` gives it, or why there is none.

    ``dead_reason`` is NULL for a row that could be read; such a row may still lack fields. Of a dead
    letter the bytes are kept in ``dead_value``. Both come from one parse, which notes what it could not read.
    """
    change = F.from_json(
        F.col("value").cast("string"), f"{change_ddl(fields)}, _unread string", {"columnNameOfCorruptRecord": "_unread"}
    )
    # a generator is not merged with what follows it, so the parse is not repeated for each column
    parsed = messages.select(F.inline(F.array(F.struct(F.col("value").alias("bytes"), change.alias("change")))))
    after, unread = F.col("change.payload.after"), F.col("change._unread").isNotNull()
    reason = (
        F.when(F.col("bytes").isNull(), "no bytes")
        .when(F.col("change.payload").isNull(), F.when(unread, "not a message").otherwise("no payload"))
        .when(after.isNull(), F.when(unread, "not a row").otherwise("no row"))
        .when(unread & after["job_id"].isNull(), "job unreadable")
    )
    names = fields or list(TRACKING)
    rows = parsed.select(*[after[name].alias(name) for name in names], reason.alias("dead_reason"), "bytes")
    dead = F.when(F.col("dead_reason").isNotNull(), F.col("bytes")).alias("dead_value")
    return normalize_ts(rows.select(*names, "dead_reason", dead))


def living(read: DataFrame) -> DataFrame:
    return read.where(F.col("dead_reason").isNull()).drop("dead_reason", "dead_value")


def dead_letters(read: DataFrame) -> DataFrame:
    """``reason, value`` of the messages that gave no row."""
    dead = read.where(F.col("dead_reason").isNotNull())
    return dead.select(F.col("dead_reason").alias("reason"), F.col("dead_value").alias("value"))
