"""Change capture: scan, publish, then move the cursor."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyhour.functions import EPOCH, instant, iso_text
from tallyhour.operators.capture import cursor_columns, first_span, incremental_scan
from tallyhour.operators.envelope import to_envelope
from tallyhour.sinks.cursor import CursorTable
from tallyhour.sinks.ledger import SentLedger

# Fixed value: seconds between polls.
POLL_SECONDS = 0.5


@dataclass(frozen=True)
class Increment:
    cursor: str
    next_cursor: str
    sent: int


def run_increment(
    tracking: DataFrame,
    cursors: CursorTable,
    publish: Callable[[DataFrame], None],
    poll_start: str | None = None,
    settle: str | None = None,
    overlap: str | None = None,
    span: str | None = None,
    strict: bool = False,
    ledger: SentLedger | None = None,
    lease: int | None = None,
) -> Increment:
    """Publish everything after the stored cursor and store the next one.

    Count and newest ``ts`` are observed on the rows as they are published, so the raw
    table is read once. The cursor is saved only after the publish returned: a crash in
    between sends rows again, which readers drop by ``create_time``. ``span`` limits an
    increment to that much time, so that the first scan of a long table stores its
    progress on the way; rows are then sent by later increments, with the operation code of the
    first load until that is through. ``strict`` keeps to
    a bare ``ts > cursor`` without an upper bound, settling time or overlap.

    With ``ledger``, rows of the overlap that were sent before are left out, so that each is sent once. Rows that a
    later overlap may reach are written down first; exactly those are published and then recorded. Everything older, such
    as a first load, is published straight from the scan. ``lease`` is that of ``CursorTable.take_lease``.
    """
    spark = tracking.sparkSession
    poll_start = poll_start or datetime.now(timezone.utc).isoformat()
    seen_state = cursors.state(spark, lease)
    cursor = seen_state.last_scan_time
    fresh = cursor.startswith("1970")
    snapshot_until = seen_state.snapshot_until or (poll_start if span and fresh else None)
    until = snapshot_until or poll_start
    if strict and not snapshot_until:
        scan = incremental_scan(tracking, cursor)
    else:
        # a first load in spans ends where it would have ended as one scan
        limits = {} if strict else {"settle": settle, "overlap": overlap}
        scan = incremental_scan(tracking, cursor, until=until, **limits)

    def send(rows: DataFrame) -> Increment:
        following, sent = cursor_columns(cursor, poll_start, strict and not snapshot_until)
        seen = Observation()
        observed = rows.observe(seen, iso_text(following).alias("next_cursor"), sent)
        publish(to_envelope(observed, EPOCH if snapshot_until else cursor))
        return Increment(cursor, seen.get["next_cursor"], seen.get["sent"])

    # most spans have rows near the cursor; only after one without is the next row looked for in all
    rows = first_span(scan, cursor, span, near=not fresh) if span else scan
    if ledger and overlap and not strict:
        result = _send_once(rows, cursor, overlap, ledger, send)
    else:
        result = send(rows)
    finished = parse(result.next_cursor) == parse(cursor)
    cursors.save(spark, result.next_cursor, None if finished else snapshot_until, seen_state)
    return result


def _send_once(
    scan: DataFrame, cursor: str, overlap: str, ledger: SentLedger, send: Callable[[DataFrame], Increment]
) -> Increment:
    """Send the rows of a scan that the ledger does not hold, and record those the next overlap may reach.

    The newest row is looked for first, which reads one column; what arrives meanwhile can only move the cursor, and
    with it the overlap, further on.
    """
    spark = scan.sparkSession
    newest = F.greatest(F.max("ts"), instant(cursor))
    reach = F.expr(f"INTERVAL {overlap}")
    newest, horizon, horizon_second = scan.where(F.col("ts") > instant(cursor)).agg(
        iso_text(newest), iso_text(newest - reach), F.unix_seconds(newest - reach)
    ).first()
    unsent = ledger.unsent(scan)
    kept = ledger.landed(unsent.where(F.col("ts") > instant(horizon)))
    result = send(unsent.where(F.col("ts") <= instant(horizon)).unionByName(kept))
    ledger.add(kept)
    ledger.expire(spark, horizon_second)
    # after a crash between record and cursor the newest rows are sent, though not in this scan
    following = max(newest, result.next_cursor, key=parse)
    return Increment(result.cursor, following, result.sent)


def parse(cursor: str) -> datetime:
    return datetime.fromisoformat(cursor.replace("Z", "+00:00"))


def poll(increment: Callable[[], Increment], polls: int | None = None, seconds: float = POLL_SECONDS) -> int:
    """Run increments at an interval, for raw tables that cannot be read as a stream.

    Errors are raised, not retried here: the cursor has not moved, so a restart resumes.
    Returns the number of rows sent.
    """
    total, done = 0, 0
    while polls is None or done < polls:
        started = time.monotonic()
        total += increment().sent
        done += 1
        if polls is None or done < polls:
            time.sleep(max(0.0, seconds - (time.monotonic() - started)))
    return total
