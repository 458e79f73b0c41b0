from __future__ import annotations

from support import event, rows_of
from pyspark.sql import functions as F

from tallyhour.operators.dedup import conflicting_changes, distinct_changes
from tallyhour.operators.envelope import to_envelope
from tallyhour.operators.rollup import hourly
from tallyhour.schemas import TRACKING
from tallyhour.session import scratch
from tallyhour.sinks.batches import published, tally_table
from tallyhour.sources.topic import topic_stream
from tallyhour.streaming.rollup import run_to_end


def test_copies_count_twice_without_dedup_and_once_with(tracking):
    raw = tracking(event(create_time="a"), event(create_time="a"), event(create_time="b"))
    assert rows_of(hourly(raw), "clicks") == [(3,)]
    assert rows_of(hourly(distinct_changes(raw)), "clicks") == [(2,)]


def test_rows_without_a_key_all_stay(tracking):
    raw = tracking(event(create_time=None), event(create_time=None), event(create_time="a"))
    assert rows_of(distinct_changes(raw), "create_time") == [("a",), (None,), (None,)]


def test_the_greatest_copy_wins_whatever_the_order(tracking):
    old, new = event(create_time="a", bid=1.0), event(create_time="a", bid=2.0)
    for rows in ((old, new), (new, old)):
        assert rows_of(distinct_changes(tracking(*rows)), "bid") == [(2.0,)]


def test_copies_that_differ_are_reported_without_a_sort(tracking):
    raw = tracking(
        event(create_time="a"), event(create_time="a"), event(create_time="b"), event(create_time="b", bid=None),
        event(create_time="b"), event(create_time=None, bid=1.0), event(create_time=None, bid=2.0), event(create_time="c"),
    )
    found = conflicting_changes(raw)
    assert rows_of(found, "create_time", "n_copies") == [("b", 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "Sort" not in plan


def test_columns_keep_their_order(tracking):
    assert distinct_changes(tracking(event())).columns == list(TRACKING)


def test_copies_collapse_before_the_shuffle(spark):
    """A change that makes up a third of the rows reaches the reducer once per task."""
    rows = spark.range(0, 90000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("create_time"),
        F.lit(1).alias("job_id"),
    )
    plan = distinct_changes(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max") > plan.index("Exchange hashpartitioning(create_time")
    assert distinct_changes(rows).count() == 60001


def test_copies_across_micro_batches(spark, tracking):
    """Redelivered messages, an old event among them, with two that have no key."""
    raw = tracking(
        event(ts="1999-01-01T00:00:00"),
        *[event(bid=0.5) for _ in range(20)],
        event(create_time=None, job=2),
        event(create_time=None, job=2),
    )
    folder = scratch(spark, "dedup")
    sent = to_envelope(raw).coalesce(1)
    sent.write.mode("append").parquet(f"{folder}/topic")
    keyed = to_envelope(raw.where("create_time IS NOT NULL"))
    for _ in range(2):
        keyed.unionByName(keyed).repartition(2).write.mode("append").parquet(f"{folder}/topic")
    table = tally_table(f"{folder}/tallies")
    options = {"path": f"{folder}/topic", "maxFilesPerTrigger": "1"}
    query = run_to_end(topic_stream(spark, options, "parquet"), table.write, f"{folder}/checkpoint", "1 hour")
    assert sum(batch["numInputRows"] > 0 for batch in query.recentProgress) == 5
    assert rows_of(published(spark, table), "job_id", "dates", "clicks", "spend_hour") == rows_of(
        hourly(raw), "job_id", "dates", "clicks", "spend_hour"
    )
