from __future__ import annotations

import json
import math

import pytest
from support import event, rows_of

from tallyhour.operators.envelope import dead_letters, living, parse_envelope, read_changes, read_or_refuse, to_envelope
from tallyhour.operators.rollup import hourly, require_job
from tallyhour.schemas import ROLLUP_FIELDS, TRACKING


def decoded(frame):
    return [json.loads(bytes(row.value).decode("utf-8")) for row in frame.collect()]


def change(**after):
    return json.dumps({"payload": {"after": after, "op": "c"}})


def test_every_field_is_written_nulls_included(tracking):
    (message,) = decoded(to_envelope(tracking({"create_time": "x"})))
    assert list(message) == ["payload"]
    assert list(message["payload"]) == ["after", "op", "ts_ms"]
    assert list(message["payload"]["after"]) == list(TRACKING)
    assert [value for name, value in message["payload"]["after"].items() if name != "create_time"] == [None] * 28


def test_bid_is_the_widened_float_and_ts_whole_millis(tracking):
    (message,) = decoded(to_envelope(tracking(event(bid=0.1, ts="2025-10-01T10:30:00.123987"))))
    after = message["payload"]["after"]
    assert after["bid"] == 0.10000000149011612
    assert after["ts"] == 1759314600123
    assert message["payload"]["op"] == "r"
    assert isinstance(message["payload"]["ts_ms"], int)


def test_round_trip_keeps_every_column(tracking):
    row = {name: f"{name} ünï \"q\" \\ \n{{}}" for name, kind in TRACKING.items() if kind == "string"}
    row |= {name: 2**31 - 1 for name, kind in TRACKING.items() if kind == "int"}
    row |= event(bid=0.1, job=-1, ts="2025-10-01T10:30:00.123")
    raw = tracking(row, {})
    assert rows_of(read_changes(to_envelope(raw)), *TRACKING) == rows_of(raw, *TRACKING)


@pytest.mark.parametrize(
    "text",
    [
        "nope",
        "{}",
        None,
        "",
        '{"payload":{"after":null,"op":"c"}}',
        '{"payload":{"after":{"job_id":1',
        '{"payload":{"after":{"job_id":"abc"}}}',
        '{"payload":{"after":{"job_id":3000000000}}}',
        '{"payload":{"after":{"job_id":2.5}}}',
        '{"after":{"job_id":1}}',
    ],
)
def test_unreadable_messages_vanish(messages, text):
    good = change(job_id=4, custom_track="click")
    changes = read_changes(messages(text, good), ROLLUP_FIELDS)
    assert rows_of(require_job(changes), "job_id") == [(4,)]
    assert hourly(changes).count() == 1


def test_bad_bid_alone_becomes_null(messages):
    changes = read_changes(messages(change(job_id=4, custom_track="click", bid="x")), ROLLUP_FIELDS)
    assert rows_of(hourly(changes), "job_id", "clicks", "bid_set", "spend_hour") == [(4, 1, None, None)]


def test_unquoted_nan_bid(messages):
    text = '{"payload":{"after":{"job_id":4,"custom_track":"click","bid":NaN},"op":"c"}}'
    (row,) = hourly(read_changes(messages(text), ROLLUP_FIELDS)).collect()
    assert math.isnan(row.bid_set) and math.isnan(row.spend_hour)


def test_nan_survives_the_round_trip(tracking):
    ((bid,),) = rows_of(read_changes(to_envelope(tracking(event(bid=float("nan"))))), "bid")
    assert math.isnan(bid)


@pytest.mark.parametrize("ts", [2**63 - 1, -(2**63)])
def test_absurd_ts_stops_at_the_end_of_the_range(messages, ts):
    facts = hourly(read_changes(messages(change(job_id=4, ts=ts)), ROLLUP_FIELDS))
    ((year,),) = rows_of(facts.selectExpr("year(dates) AS y"), "y")
    assert abs(year) > 290000


def test_unknown_fields_and_other_operations_are_read_alike(messages):
    text = '{"payload":{"after":{"job_id":4,"extra":[1]},"op":"d","ts_ms":1,"source":{}},"schema":{}}'
    assert rows_of(read_changes(messages(text)), "job_id") == [(4,)]


def test_messages_are_parsed_once(messages):
    plan = hourly(read_changes(messages("{}"), ROLLUP_FIELDS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_only_named_fields_are_parsed(messages):
    assert parse_envelope(messages("{}"), ["job_id", "ts"]).columns == ["job_id", "ts"]
    assert parse_envelope(messages("{}")).columns == list(TRACKING)


def test_dead_letters_and_rows_come_from_one_parse(spark, messages):
    read = read_or_refuse(messages(None, "{", "[]", "7", "{}", '{"payload":{"op":"c"}}', '{"payload":{"after":7}}'), ["job_id", "bid", "ts"])
    assert [row.dead_reason is not None for row in read.collect()] == [True] * 7
    whole = ('{"payload":{"after":{"job_id":1,"bid":2.5,"ts":0}}}', '{"payload":{"after":{"job_id":null,"bid":"x"}}}', '{"payload":{"after":{}}}')
    lost = '{"payload":{"after":{"job_id":"x","bid":2.5}}}'
    frame = read_or_refuse(messages(*whole, lost, "{"), ["job_id", "bid", "ts"])
    assert rows_of(living(frame), "job_id", "bid") == sorted([(1, 2.5), (None, None)], key=repr)
    assert rows_of(dead_letters(frame), "reason", "value") == sorted(
        [("job unreadable", bytearray(lost.encode())), ("not a message", bytearray(b"{")), ("job unreadable", bytearray(whole[1].encode()))], key=repr
    )
    plan = frame.where("dead_reason is null or bid > 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1
