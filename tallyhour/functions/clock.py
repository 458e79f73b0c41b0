"""Instants, epoch milliseconds and ISO-8601 cursor text."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01T00:00:00Z"

# Largest millisecond count whose microseconds still fit a 64-bit timestamp.
_MAX_MILLIS = (2**63 - 1) // 1000

_ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def saturating_instant(millis_column: Column) -> Column:
    """Epoch milliseconds to a timestamp; counts beyond the range stop at its ends.

    A message with an absurd ``ts`` must not stop the stream with an overflow.
    """
    bounded = F.least(F.greatest(millis_column, F.lit(-_MAX_MILLIS)), F.lit(_MAX_MILLIS))
    return F.when(millis_column.isNotNull(), F.timestamp_millis(bounded))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def iso_text(ts: Column) -> Column:
    """ISO-8601 with the zone offset, so the text means the same in every session."""
    return F.date_format(ts, _ISO_PATTERN)


def parse_iso(text: Column) -> Column:
    return text.cast("timestamp")


def instant(cursor: str | datetime | Column) -> Column:
    """A cursor given as ISO text, aware datetime or column, as a timestamp column."""
    if isinstance(cursor, Column):
        return cursor
    if isinstance(cursor, datetime):
        if cursor.tzinfo is None:
            raise ValueError("a cursor datetime needs a time zone")
        cursor = cursor.astimezone(timezone.utc).isoformat()
    return parse_iso(F.lit(cursor))


def op_code(cursor: str | datetime | Column) -> Column:
    """``r`` for a snapshot (cursor still in 1970), ``c`` for an increment."""
    return F.when(F.year(instant(cursor)) == 1970, "r").otherwise("c")
