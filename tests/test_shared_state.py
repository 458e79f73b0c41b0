"""Records in shared storage: who may go on, and what readers see when a writer stops."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F
from support import at, event, rows_of

from tallyhour.functions import EPOCH
from tallyhour.operators.capture import incremental_scan
from tallyhour.operators.contract import events_rows, to_events_contract
from tallyhour.operators.enrich import with_company, with_company_as_of
from tallyhour.operators.envelope import read_changes
from tallyhour.operators.integrity import Reference, remap_keys
from tallyhour.operators.rollup import hourly, tally
from tallyhour.plans.capture import run_increment
from tallyhour.plans.maintenance import backfill_company, nullify_stored, remap_stored
from tallyhour.plans.readmission import READMITTED, readmit, still_refused
from tallyhour.schemas import EVENTS, EVENTS_WRITTEN
from tallyhour.session import scratch
from tallyhour.sinks.batches import BatchTable, compact, tally_table
from tallyhour.sinks.compaction import compact_batches, compacted_table, expire_batches, served
from tallyhour.sinks.cursor import CursorTable
from tallyhour.sinks.dated import DatedTable
from tallyhour.sinks.ids import IdRanges
from tallyhour.sinks.ledger import SentLedger
from tallyhour.sinks.topic import publish
from tallyhour.sinks.versions import Superseded, Versions, names

FACT = {name: EVENTS[name] for name in EVENTS_WRITTEN}


def in_threads(work, n):
    """Run ``work(i)`` at once in n threads; what each returned or raised."""
    found = [None] * n

    def one(i):
        try:
            found[i] = work(i)
        except Exception as error:  # noqa: BLE001  handed to the test
            found[i] = error

    threads = [threading.Thread(target=one, args=(i,)) for i in range(n)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return found


# Versions


def test_a_version_is_made_once(spark):
    versions = Versions(scratch(spark, "versions"))
    assert versions.newest(spark) == (-1, {})
    versions.add(spark, 0, {"a": 1})
    with pytest.raises(Superseded):
        versions.add(spark, 0, {"a": 2})
    assert versions.newest(spark) == (0, {"a": 1})
    for number in range(1, 14):
        versions.add(spark, number, {"a": number})
    versions.forget(spark, keep=3)
    assert versions.numbers(spark) == [11, 12, 13] and versions.record(spark, 11) == {"a": 11}
    # nothing is left of the refused one
    assert [n for n in names(spark, versions.path) if n.startswith(".new")] == []


# Cursor


def test_the_second_of_two_pollers_is_refused(spark):
    cursors = CursorTable(scratch(spark, "cursor"))
    cursors.save(spark, "2025-10-01T00:00:00Z")
    one, two = cursors.state(spark), cursors.state(spark)
    cursors.save(spark, "2025-10-02T00:00:00Z", seen=one)
    with pytest.raises(Superseded):
        cursors.save(spark, "2025-10-05T00:00:00Z", seen=two)
    assert cursors.load(spark) == "2025-10-02T00:00:00.000000Z"


def test_a_new_lease_shuts_out_the_old_poller(spark):
    cursors = CursorTable(scratch(spark, "cursor"))
    old = cursors.take_lease(spark)
    cursors.save(spark, "2025-10-01T00:00:00Z", snapshot_until="2025-11-01T00:00:00Z", seen=cursors.state(spark, old))
    seen = cursors.state(spark, old)
    new = cursors.take_lease(spark)
    assert (cursors.load(spark), cursors.snapshot_until(spark)) == ("2025-10-01T00:00:00.000000Z", "2025-11-01T00:00:00Z")
    with pytest.raises(Superseded):
        cursors.save(spark, "2025-10-09T00:00:00Z", seen=seen)
    with pytest.raises(Superseded):
        cursors.state(spark, old)
    assert cursors.state(spark, new).last_scan_time == "2025-10-01T00:00:00.000000Z"


class Topic:
    def __init__(self, spark):
        self.spark, self.path = spark, scratch(spark, "topic")

    def publish(self, messages):
        publish(messages, {"path": self.path}, "parquet")

    def keys(self):
        changes = read_changes(self.spark.read.schema("value binary").parquet(self.path))
        return [row.create_time for row in changes.select("create_time").orderBy("create_time").collect()]


def test_two_pollers_skip_nothing(spark, tracking):
    topic, cursors = Topic(spark), CursorTable(scratch(spark, "cursor"))
    rows = [event(ts=f"2025-10-01T{h:02d}:00:00") for h in range(10)]
    old = cursors.take_lease(spark)
    run_increment(tracking(*rows[:3]), cursors, topic.publish, "2025-10-05T00:00:00Z", lease=old)

    def slow(messages):
        # another poller starts and finishes while this one publishes
        new = cursors.take_lease(spark)
        run_increment(tracking(*rows[:6]), cursors, topic.publish, "2025-10-05T00:00:00Z", lease=new)
        topic.publish(messages)

    with pytest.raises(Superseded):
        run_increment(tracking(*rows), cursors, slow, "2025-10-05T00:00:00Z", lease=old)
    run_increment(tracking(*rows), cursors, topic.publish, "2025-10-05T00:00:00Z")
    assert sorted(set(topic.keys())) == [f"t{n}" for n in range(10)]


# Ledger


def poller(spark, overlap="1 hour"):
    topic, folder = Topic(spark), scratch(spark, "ledger")
    cursors, ledger = CursorTable(f"{folder}/cursor"), SentLedger(f"{folder}/ledger")

    def run(rows, poll_start="2025-10-05T00:00:00Z", publish=topic.publish, **more):
        return run_increment(rows, cursors, publish, poll_start, overlap=overlap, ledger=ledger, **more)

    return topic, cursors, ledger, run


def test_rows_of_the_overlap_are_sent_once(spark, tracking):
    topic, _, ledger, run = poller(spark)
    rows = [event(ts=f"2025-10-01T10:{m:02d}:00") for m in (0, 20, 40)] + [event(ts=None)]
    late = {**event(ts="2025-10-01T10:10:00"), "create_time": "late"}
    assert [run(tracking(*rows)).sent for _ in range(3)] == [3, 0, 0]
    assert [run(tracking(*rows, late)).sent for _ in range(2)] == [1, 0]
    new = {**event(ts="2025-10-01T14:00:00"), "create_time": "new"}
    assert [run(tracking(*rows, late, new)).sent for _ in range(2)] == [1, 0]
    assert topic.keys() == ["late", "new", "t0", "t1", "t2"]
    # only the hours a later scan may reach are kept: 13:00 on
    assert [hour % 24 for hour in ledger.hours(spark)] == [14]


def test_a_changed_row_is_sent_again(spark, tracking):
    _, _, _, run = poller(spark)
    assert run(tracking(event(bid=1.0))).sent == 1
    assert [run(tracking(event(bid=2.0))).sent for _ in range(2)] == [1, 0]


def test_rows_without_a_key_are_known_by_their_columns(spark, tracking):
    _, _, _, run = poller(spark)
    keyless = {**event(), "create_time": None}
    assert [run(tracking(keyless)).sent for _ in range(2)] == [1, 0]
    assert run(tracking(keyless, {**keyless, "bid": 9.0})).sent == 1


def test_a_crash_before_the_record_sends_again_and_after_it_does_not(spark, tracking, monkeypatch):
    topic, cursors, ledger, run = poller(spark)
    rows = tracking(event(ts="2025-10-01T10:00:00"), event(ts="2025-10-01T10:30:00"))

    def broken(*_, **__):
        raise OSError("stopped")

    with monkeypatch.context() as patched:
        patched.setattr(SentLedger, "add", broken)
        with pytest.raises(OSError):
            run(rows)
    assert cursors.load(spark) == EPOCH and run(rows).sent == 2
    more = tracking(event(ts="2025-10-01T10:00:00"), event(ts="2025-10-01T10:30:00"), event(ts="2025-10-01T10:50:00"))
    with monkeypatch.context() as patched:
        patched.setattr(CursorTable, "save", broken)
        with pytest.raises(OSError):
            run(more)
    # recorded but not passed by the cursor: nothing to send, and the cursor goes on
    assert run(more).sent == 0
    assert cursors.load(spark) == "2025-10-01T10:50:00.000000Z"
    assert topic.keys() == ["t0", "t0", "t1", "t1", "t2"]


def test_only_hours_of_the_ledger_are_joined(spark, tracking, conf):
    conf(spark__sql__maxMetadataStringLength="10000")
    ledger = SentLedger(scratch(spark, "ledger"))
    ledger.add(tracking(event(ts="2025-10-01T10:00:00")))
    folder = scratch(spark, "raw")
    tracking(event(ts="2025-10-01T10:00:00"), event(ts="2025-10-03T10:00:00")).write.parquet(folder)
    scan = incremental_scan(spark.read.parquet(folder), "2025-09-01T00:00:00Z")
    unsent = ledger.unsent(scan)
    plan = unsent._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(ts,2025-10-01 11:00:00" in plan and "GreaterThanOrEqual(ts,2025-10-01 11:00:00" in plan
    assert [row.create_time for row in unsent.collect()] == ["t1"]


# Tables by date


def facts(spark, *rows):
    """Rows of (job, date, publisher, company, clicks)."""
    made = [(job, date, 1, publisher, 0, company, 0, 0, 0, 0, clicks, None, 0.0) for job, date, publisher, company, clicks in rows]
    frame = spark.createDataFrame(
        made,
        "job_id int, dates string, hours int, publisher_id int, campaign_id int, company_id int, group_id int, "
        "disqualified_application long, qualified_application long, conversion long, clicks long, bid_set double, spend_hour double",
    )
    return frame.withColumn("dates", F.col("dates").cast("date"))


SEEN = ("job_id", "publisher_id", "company_id", "clicks")


def stored(spark, *rows):
    table = DatedTable(scratch(spark, "dated"), FACT)
    table.append(facts(spark, *rows))
    return table


def test_an_empty_table(spark):
    table = DatedTable(scratch(spark, "dated"), FACT)
    assert table.read(spark).columns == EVENTS_WRITTEN and table.read(spark).count() == 0
    table.append(facts(spark))
    assert table.read(spark).count() == 0
    assert table.rewrite(spark, lambda f: f, lambda f: f).folders == {}


def test_only_touched_dates_are_copied(spark):
    table = stored(spark, (1, "2025-10-01", 1, None, 5), (2, "2025-10-02", 1, 7, 6), (1, None, 1, 7, 7))
    before = table.snapshot(spark)
    nullify_stored(spark, table, Reference("job_id", spark.createDataFrame([(1,)], "job_id int"), "job_id"))
    after = table.snapshot(spark)
    assert {d for d in after.folders if after.folders[d] != before.folders[d]} == {"dates=2025-10-02"}
    assert rows_of(table.read(spark), *SEEN) == sorted([(1, 1, None, 5), (None, 1, 7, 6), (1, 1, 7, 7)], key=repr)
    # a reader that began before still reads what it began with
    assert rows_of(table.read(spark, before), *SEEN) == sorted([(1, 1, None, 5), (2, 1, 7, 6), (1, 1, 7, 7)], key=repr)
    table.expire(spark, keep=1)
    assert table.read(spark).count() == 3 and len(names(spark, f"{table.path}/data")) == 2


def test_a_date_whose_rows_all_go(spark):
    table = stored(spark, (1, "2025-10-01", 1, 7, 5), (2, "2025-10-02", 1, 7, 6))
    table.rewrite(spark, lambda f: f.where("job_id = 1"), lambda f: f.where("job_id <> 1"))
    assert rows_of(table.read(spark), *SEEN) == [(2, 1, 7, 6)]


def test_writers_that_meet_lose_nothing(spark):
    table = DatedTable(scratch(spark, "dated"), FACT)
    found = in_threads(lambda i: table.append(facts(spark, (i, "2025-10-01", 1, 7, i))), 4)
    assert not [error for error in found if isinstance(error, Exception)]
    assert sorted(r.job_id for r in table.read(spark).collect()) == [0, 1, 2, 3]


def test_keys_that_are_both_old_and_new(spark):
    table = stored(spark, (1, "2025-10-01", 1, 7, 1), (1, "2025-10-02", 2, 7, 2), (1, "2025-10-03", 5, 7, 3))
    moves = spark.createDataFrame([(1, 2), (2, 3), (5, 5)], "old_key int, new_key int")
    for _ in range(2):
        remap_stored(spark, table, "publisher_id", moves, "renumbering 1")
    assert rows_of(table.read(spark), "publisher_id", "clicks") == [(2, 1), (3, 2), (5, 3)]
    remap_stored(spark, table, "publisher_id", moves, "renumbering 2")
    assert rows_of(table.read(spark), "publisher_id", "clicks") == [(3, 1), (3, 2), (5, 3)]


def test_a_repeated_old_key_is_refused(spark):
    twice = spark.createDataFrame([(1, 2), (1, 3)], "old_key int, new_key int")
    with pytest.raises(ValueError):
        remap_keys(facts(spark, (1, "2025-10-01", 1, 7, 1)), "publisher_id", twice)
    with pytest.raises(ValueError):
        remap_stored(spark, stored(spark, (1, "2025-10-01", 1, 7, 1)), "publisher_id", twice, "x")


def test_companies_are_filled_where_none_was(spark):
    table = stored(spark, (1, "2025-10-01", 1, None, 1), (2, "2025-10-01", 1, 20, 2), (3, "2025-10-02", 1, None, 3), (None, "2025-10-03", 1, None, 4))
    job = spark.createDataFrame([(1, 10, 0, 0), (2, 99, 0, 0), (4, None, 0, 0)], "job_id int, company_id int, group_id int, campaign_id int")
    before = table.snapshot(spark)
    backfill_company(spark, table, job)
    assert rows_of(table.read(spark), "job_id", "company_id") == sorted([(1, 10), (2, 20), (3, None), (None, None)], key=repr)
    after = table.snapshot(spark)
    assert {d for d in after.folders if after.folders[d] != before.folders[d]} == {"dates=2025-10-01"}
    assert backfill_company(spark, table, job) == after


def test_company_at_the_hour(spark, tracking):
    rows = hourly(tracking(event(ts="2025-10-01T09:30:00"), event(ts="2025-10-01T10:30:00"), event(ts="2025-10-02T00:00:00"), event(job=2), event(ts=None)))
    history = spark.createDataFrame(
        [(1, 10, None), (1, 11, at("2025-10-01T10:00:00")), (1, 12, at("2025-10-02T00:00:00")), (1, 13, at("2025-10-02T00:00:00")), (2, 20, at("2025-10-01T10:30:00"))],
        "job_id int, company_id int, valid_from timestamp",
    )
    found = rows_of(with_company_as_of(rows, history).withColumn("d", F.col("dates").cast("string")), "job_id", "d", "hours", "company_id")
    # a job known from half past does not hold for the hour it began in
    assert found == sorted([(1, "2025-10-01", 9, 10), (1, "2025-10-01", 10, 11), (1, "2025-10-02", 0, 13), (1, None, None, 10), (2, "2025-10-01", 10, None)], key=repr)


# Compaction


def batch(tallies, tracking, stream, number, *rows):
    tallies.write(tally(tracking(*rows)), number, stream)


def test_compaction_counts_every_batch_once(spark, tracking):
    folder = scratch(spark, "compaction")
    tallies, table = tally_table(f"{folder}/tallies"), compacted_table(f"{folder}/dated")
    clicks = lambda: sum(r.clicks for r in served(spark, tallies, table).collect())
    assert clicks() == 0 and compact_batches(spark, tallies, table).version == -1
    batch(tallies, tracking, "a", 0, event(), event(bid=3.0))
    batch(tallies, tracking, "a", 5, event(bid=5.0))
    assert clicks() == 3
    compact_batches(spark, tallies, table)
    # a batch with a lower number than any of the other stream
    batch(tallies, tracking, "b", 0, event(), event(ts="2025-10-02T10:00:00"))
    assert clicks() == 5

    def stop():
        raise OSError("stopped")

    with pytest.raises(OSError):
        compact_batches(spark, tallies, table, before_switch=stop)
    assert clicks() == 5
    seen = compact_batches(spark, tallies, table)
    assert seen.notes["covered"] == {"a": 5, "b": 0} and clicks() == 5
    assert compact_batches(spark, tallies, table) == seen
    assert {r.bid_set for r in served(spark, tallies, table).where("dates = '2025-10-01'").collect()} == {2.5}
    # a's newest batch may be repeated, its first is covered by the record before
    assert expire_batches(spark, tallies, table) == 1 and clicks() == 5


def test_a_batch_still_being_written_is_not_covered(spark, tracking):
    folder = scratch(spark, "compaction")
    tallies, table = tally_table(f"{folder}/tallies"), compacted_table(f"{folder}/dated")
    batch(tallies, tracking, "a", 0, event())
    tally(tracking(event())).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{folder}/tallies/stream_id=a/batch_id=1"
    )
    assert compact_batches(spark, tallies, table).notes["covered"] == {"a": 0}
    assert [r.clicks for r in served(spark, tallies, table).collect()] == [2]


def test_the_first_batch_counts_within_a_stream(spark, tracking):
    folder = scratch(spark, "since")
    tallies = tally_table(f"{folder}/tallies")
    batch(tallies, tracking, "a", 5, event())
    compact(spark, tallies, f"{folder}/events")
    batch(tallies, tracking, "b", 0, event(ts="2025-10-02T10:00:00"))
    with pytest.raises(ValueError):
        compact(spark, tallies, f"{folder}/events", since_batch=5)
    compact(spark, tallies, f"{folder}/events", since_batch={"a": 6})
    assert spark.read.parquet(f"{folder}/events").count() == 2


# Readmission


def test_rows_come_back_once(spark):
    folder = scratch(spark, "back")
    good = BatchTable(f"{folder}/good", FACT)
    bad = BatchTable(f"{folder}/bad", {**FACT, "failed_reference": "string"})
    publishers = lambda *ids: Reference("publisher_id", spark.createDataFrame([(i,) for i in ids], "id int"), "id")
    refused = lambda *rows: facts(spark, *rows).withColumn("failed_reference", F.lit("publisher_id"))
    bad.write(refused((1, "2025-10-01", 1, 7, 1), (1, "2025-10-01", 2, 7, 2)), 0, "s")
    path = f"{folder}/passes"

    def stop():
        raise OSError("stopped")

    with pytest.raises(OSError):
        readmit(spark, bad, path, good, [publishers(1)], before_switch=stop)
    # the pass is repeated, now with a larger table, and replaces what it had written
    assert readmit(spark, bad, path, good, [publishers(1)]) == 0
    assert rows_of(good.read(spark), "publisher_id", "clicks", "stream_id", "batch_id") == [(1, 1, READMITTED, 0)]
    assert rows_of(still_refused(spark, bad, path), "publisher_id", "clicks") == [(2, 2)]
    bad.write(refused((1, "2025-10-02", 3, 7, 3)), 1, "s")
    assert rows_of(still_refused(spark, bad, path), "publisher_id", "clicks") == [(2, 2), (3, 3)]
    assert readmit(spark, bad, path, good, [publishers(1, 2, 3)]) == 1
    assert readmit(spark, bad, path, good, [publishers(1, 2, 3)]) == 2
    assert rows_of(good.read(spark), "publisher_id", "clicks") == [(1, 1), (2, 2), (3, 3)]
    assert still_refused(spark, bad, path).count() == 0


# Ids


def test_ranges_do_not_meet(spark):
    ranges = IdRanges(scratch(spark, "ids"))
    ranges.begin_after(spark, 1000)
    found = sorted(in_threads(lambda i: ranges.reserve(spark, i + 1), 6))
    ends = sorted(in_threads(lambda i: ranges.reserve(spark, 0), 1))
    assert found[0] == 1000 and ends == [1000 + 21]
    sizes = [b - a for a, b in zip(found, [*found[1:], ends[0]])]
    assert sorted(sizes) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        ranges.reserve(spark, -1)


def test_two_appenders_at_once(spark, tracking):
    path, ranges = scratch(spark, "facts"), IdRanges(scratch(spark, "ids"))
    job = spark.createDataFrame([(1, 10)], "job_id int, company_id int")

    def append(i):
        rows = hourly(tracking(*[event(job=j + 100 * i) for j in range(20)]))
        made = events_rows(spark, to_events_contract(with_company(rows, job)), lambda n: ranges.reserve(spark, n))
        plan = made._jdf.queryExecution().executedPlan().toString()
        made.write.parquet(f"{path}/appender={i}")
        return plan

    plans = in_threads(append, 3)
    assert not [p for p in plans if isinstance(p, Exception) or path in p]
    ids = [row.id for row in spark.read.parquet(path).select("id").collect()]
    assert len(ids) == len(set(ids)) == 60 and min(ids) == 1 and max(ids) == 60
