"""Incremental scan of the raw table and the cursor rule."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhour.functions import instant, iso_text

Cursor = str | datetime | Column


def incremental_scan(
    tracking: DataFrame,
    cursor: Cursor,
    until: Cursor | None = None,
    settle: str | None = None,
    overlap: str | None = None,
) -> DataFrame:
    """Rows after ``cursor``: ``ts > cursor``, never those without a ``ts``.

    ``until`` bounds the scan by the poll start, so a row dated in the future waits for
    its time. Rows may arrive after others with a later ``ts``. ``settle`` (an interval
    such as ``2 seconds``) keeps that far behind ``until`` and so loses no row that is
    late by less, at the price of as much delay. ``overlap`` instead reaches back before
    the cursor, which sends that stretch again: readers drop the copies by
    ``create_time``. All bounds are constants and reach the source as pushed filters.
    """
    after = instant(cursor)
    if overlap:
        after = after - F.expr(f"INTERVAL {overlap}")
    rows = tracking.where(F.col("ts") > after)
    if until is None:
        return rows
    last = instant(until)
    if settle:
        last = last - F.expr(f"INTERVAL {settle}")
    return rows.where(F.col("ts") <= last)


def first_span(scan: DataFrame, cursor: Cursor, span: str, near: bool = False) -> DataFrame:
    """The rows of a scan up to ``span`` (an interval) past its earliest ``ts`` after ``cursor``.

    Finding that ``ts`` reads one column; as a literal it then bounds the scan itself. With ``near`` it is first
    looked for within a span of the cursor, so that not all later rows are read for it. Rows
    of an overlap lie before the cursor and do not count, or the cursor might never move.
    """
    later = scan.where(F.col("ts") > instant(cursor))
    length = F.expr(f"INTERVAL {span}")
    earliest = _earliest(later.where(F.col("ts") <= instant(cursor) + length)) if near else None
    earliest = earliest or _earliest(later)
    return scan if earliest is None else scan.where(F.col("ts") <= instant(earliest) + length)


def _earliest(rows: DataFrame) -> str | None:
    return rows.agg(iso_text(F.min("ts")).alias("ts")).first().ts


def cursor_columns(cursor: Cursor, poll_start: Cursor, strict: bool = False) -> list[Column]:
    """Aggregates of a scan: the next cursor and the number of rows.

    The next cursor is the greatest ``ts`` seen. A scan without rows leaves it where it
    was; ``strict`` moves it to the poll start instead, past anything that arrives late.
    """
    newest = F.max("ts")
    if strict:
        following = F.coalesce(newest, instant(poll_start))
    else:
        following = F.greatest(newest, instant(cursor))
    return [following.alias("next_cursor"), F.count(F.lit(1)).alias("sent")]


def next_cursor(scan: DataFrame, cursor: Cursor, poll_start: Cursor, strict: bool = False) -> DataFrame:
    return scan.agg(*cursor_columns(cursor, poll_start, strict))
