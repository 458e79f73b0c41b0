from __future__ import annotations

from datetime import datetime, timezone
from pathlib import Path

import pytest
from support import SF, event, rows_of

from tallyhour.functions import EPOCH, instant, op_code
from tallyhour.operators.capture import incremental_scan, next_cursor
from tallyhour.operators.dedup import distinct_changes
from tallyhour.operators.envelope import read_changes
from tallyhour.plans import inputs
from tallyhour.plans.capture import Increment, poll, run_increment
from tallyhour.session import scratch
from tallyhour.sinks.cursor import CursorTable
from tallyhour.sinks.topic import publish
from pyspark.sql import functions as F

POLL = "2025-10-05T00:00:00Z"


@pytest.fixture
def raw(tracking):
    return tracking(
        event(ts="2025-10-01T10:00:00"),
        event(ts="2025-10-02T10:00:00"),
        event(ts="2025-10-02T10:00:00"),
        event(ts=None),
        event(ts="2025-10-09T00:00:00"),
    )


def names(frame):
    return [name for (name,) in rows_of(frame, "create_time")]


def test_scan_is_strict_and_needs_a_ts(raw):
    assert names(incremental_scan(raw, EPOCH)) == ["t0", "t1", "t2", "t4"]
    assert names(incremental_scan(raw, "2025-10-02T10:00:00Z")) == ["t4"]
    assert names(incremental_scan(raw, "2025-10-02T09:59:59.999999Z")) == ["t1", "t2", "t4"]


def test_bounds(raw):
    assert names(incremental_scan(raw, "2025-10-02T10:00:00Z", until=POLL)) == []
    assert names(incremental_scan(raw, "2025-10-02T10:00:00Z", until=POLL, overlap="1 hour")) == ["t1", "t2"]


def test_cursor_accepts_aware_datetimes_only(raw):
    assert names(incremental_scan(raw, datetime(2025, 10, 3, tzinfo=timezone.utc))) == ["t4"]
    with pytest.raises(ValueError):
        instant(datetime(2025, 10, 3))


def test_cursor_bound_reaches_the_scan(spark):
    scan = incremental_scan(inputs.tracking(spark, SF), "2024-01-15T00:00:00Z", until="2024-01-20T00:00:00Z")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts,2024-01-15 00:00:00.0)" in plan
    assert "LessThanOrEqual(ts,2024-01-20 00:00:00.0)" in plan


def test_operation_code(spark):
    for cursor, code in ((EPOCH, "r"), ("1970-12-31T23:59:59Z", "r"), ("1971-01-01T00:00:00Z", "c")):
        assert spark.range(1).select(op_code(cursor)).first()[0] == code


@pytest.mark.parametrize(
    "cursor, strict, expected",
    [
        (EPOCH, False, ("2025-10-09 00:00:00", 4)),
        (EPOCH, True, ("2025-10-09 00:00:00", 4)),
        ("2025-11-01T00:00:00Z", False, ("2025-11-01 00:00:00", 0)),
        ("2025-11-01T00:00:00Z", True, ("2025-10-05 00:00:00", 0)),
    ],
)
def test_next_cursor(raw, cursor, strict, expected):
    found = next_cursor(incremental_scan(raw, cursor), cursor, POLL, strict)
    assert rows_of(found.withColumn("next_cursor", F.col("next_cursor").cast("string")), "next_cursor", "sent") == [expected]


def test_cursor_table_keeps_the_newest(spark):
    cursors = CursorTable(scratch(spark, "cursor"))
    assert cursors.load(spark) == EPOCH
    for text in ("2025-10-01T00:00:00Z", "2025-10-02T00:00:00.5Z", "2025-10-03T02:00:00+02:00"):
        cursors.save(spark, text)
    assert cursors.load(spark) == "2025-10-03T00:00:00.000000Z"


def test_a_save_cut_short_leaves_the_previous_cursor(spark):
    cursors = CursorTable(scratch(spark, "cursor"))
    cursors.save(spark, "2025-10-01T00:00:00Z")
    cursors.save(spark, "2025-10-02T00:00:00Z")
    # what a save leaves when it dies before its record has a number
    Path(f"{cursors.path.removeprefix('file:')}/.new-0").write_text('{"last_scan')
    assert cursors.load(spark) == "2025-10-02T00:00:00.000000Z"


class Topic:
    def __init__(self, spark):
        self.spark, self.path = spark, scratch(spark, "topic")

    def publish(self, messages):
        publish(messages, {"path": self.path}, "parquet")

    def changes(self):
        return read_changes(self.spark.read.schema("value binary").parquet(self.path))


def test_increments_send_new_rows_only(spark, tracking):
    topic, cursors = Topic(spark), CursorTable(scratch(spark, "cursor"))
    early, late = event(ts="2025-10-01T10:00:00"), event(ts="2025-10-02T10:00:00")
    first = run_increment(tracking(early), cursors, topic.publish, POLL)
    assert first == Increment(EPOCH, "2025-10-01T10:00:00.000000Z", 1)
    second = run_increment(tracking(early, late), cursors, topic.publish, POLL)
    assert (second.sent, second.next_cursor) == (1, "2025-10-02T10:00:00.000000Z")
    third = run_increment(tracking(early, late), cursors, topic.publish, POLL)
    assert (third.sent, third.next_cursor) == (0, second.next_cursor)
    assert names(topic.changes()) == ["t0", "t1"]


def test_empty_table_keeps_the_cursor(spark, tracking):
    topic, cursors = Topic(spark), CursorTable(scratch(spark, "cursor"))
    nothing = tracking(event()).where("false")
    assert run_increment(nothing, cursors, topic.publish, POLL).sent == 0
    assert cursors.load(spark).startswith("1970-01-01T00:00:00")
    assert run_increment(nothing, cursors, topic.publish, POLL, strict=True).next_cursor == "2025-10-05T00:00:00.000000Z"


def test_late_row_with_the_newest_ts(spark, tracking):
    """Missed by the strict cursor, found by the overlap; its earlier twin drops out as a copy."""
    seen, twin = event(ts="2025-10-02T10:00:00"), event(ts="2025-10-02T10:00:00")
    for strict, found in ((True, ["t0"]), (False, ["t0", "t1"])):
        topic, cursors = Topic(spark), CursorTable(scratch(spark, "cursor"))
        for rows in ((seen,), (seen, twin)):
            run_increment(tracking(*rows), cursors, topic.publish, POLL, overlap="1 minute", strict=strict)
        assert names(distinct_changes(topic.changes())) == found


def test_settling_time_waits_for_late_rows(spark, tracking):
    """A row that arrives a second late is sent once, without copies of the others."""
    topic, cursors = Topic(spark), CursorTable(scratch(spark, "cursor"))
    first, late = event(ts="2025-10-02T10:00:00"), event(ts="2025-10-02T09:59:59.500")
    run_increment(tracking(first), cursors, topic.publish, "2025-10-02T10:00:00.5Z", settle="2 seconds")
    assert cursors.load(spark).startswith("1970")
    run_increment(tracking(first, late), cursors, topic.publish, "2025-10-02T10:00:02Z", settle="2 seconds")
    run_increment(tracking(first, late), cursors, topic.publish, "2025-10-02T10:00:09Z", settle="2 seconds")
    assert names(topic.changes()) == ["t0", "t1"]


def test_a_long_scan_in_spans(spark, raw):
    topic, cursors = Topic(spark), CursorTable(scratch(spark, "cursor"))
    steps = [run_increment(raw, cursors, topic.publish, "2025-10-10T00:00:00Z", span="12 hours") for _ in range(4)]
    assert [step.sent for step in steps] == [1, 2, 1, 0]
    assert steps[3].next_cursor == "2025-10-09T00:00:00.000000Z"
    assert names(topic.changes()) == ["t0", "t1", "t2", "t4"]


def test_spans_advance_under_a_longer_overlap(spark, raw):
    topic, cursors = Topic(spark), CursorTable(scratch(spark, "cursor"))
    for _ in range(4):
        run_increment(raw, cursors, topic.publish, "2025-10-10T00:00:00Z", overlap="30 days", span="1 hour")
    assert cursors.load(spark) == "2025-10-09T00:00:00.000000Z"
    assert names(distinct_changes(topic.changes())) == ["t0", "t1", "t2", "t4"]


def test_future_row_waits_for_its_time(spark, raw):
    topic, cursors = Topic(spark), CursorTable(scratch(spark, "cursor"))
    for poll_start in (POLL, "2025-10-05T00:00:01Z", "2025-10-10T00:00:00Z"):
        run_increment(raw, cursors, topic.publish, poll_start)
    assert names(topic.changes()) == ["t0", "t1", "t2", "t4"]


def test_failed_publish_leaves_the_cursor(spark, raw):
    cursors = CursorTable(scratch(spark, "cursor"))

    def broken(messages):
        raise OSError("topic is down")

    with pytest.raises(OSError):
        run_increment(raw, cursors, broken, POLL)
    assert cursors.load(spark) == EPOCH


def test_poll_adds_up(spark):
    sent = iter([Increment("a", "b", 3), Increment("b", "c", 0), Increment("c", "d", 2)])
    assert poll(lambda: next(sent), polls=3, seconds=0) == 5


def test_snapshot_then_increment_codes(spark, tracking):
    topic, cursors = Topic(spark), CursorTable(scratch(spark, "cursor"))
    run_increment(tracking(event(ts="2025-10-01T10:00:00")), cursors, topic.publish, POLL)
    run_increment(tracking(event(), event(ts="2025-10-02T10:00:00")), cursors, topic.publish, POLL)
    value = F.col("value").cast("string")
    codes = spark.read.parquet(topic.path).select(
        F.get_json_object(value, "$.payload.after.create_time").alias("c"), F.get_json_object(value, "$.payload.op").alias("op")
    )
    assert rows_of(codes, "c", "op") == [("t0", "c"), ("t0", "r"), ("t1", "c")]
