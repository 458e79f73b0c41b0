from __future__ import annotations

import pytest
from support import event, rows_of
from pyspark.sql import functions as F

from tallyhour.operators.enrich import with_company
from tallyhour.operators.integrity import Reference, nullify_deleted, remap_keys, split_by_reference
from tallyhour.operators.joins import sized
from tallyhour.operators.rollup import hourly

JOBS = "job_id int, company_id int, group_id int, campaign_id int"


@pytest.fixture
def job(spark):
    return spark.createDataFrame([(1, 10, 99, 98), (2, None, 99, 98)], JOBS)


def test_company_joins_and_event_values_win(tracking, job):
    facts = with_company(hourly(tracking(event(job=1), event(job=2), event(job=99))), job)
    got = rows_of(facts, "job_id", "company_id", "group_id", "campaign_id")
    assert got == [(1, 10, 45, 301), (2, None, 45, 301), (99, None, 45, 301)]
    assert facts.columns.count("group_id") == 1


def facts(spark):
    return spark.createDataFrame([(1, 0), (2, 15), (None, None), (9, 16), (0, 15)], "job_id int, publisher_id int")


def test_missing_keys_are_valid_and_zero_is_a_key(spark, job):
    publisher = spark.createDataFrame([(15,), (16,)], "id int")
    references = [Reference("job_id", job, "job_id"), Reference("publisher_id", publisher, "id")]
    good, bad = split_by_reference(facts(spark), *references)
    assert rows_of(good, "job_id", "publisher_id") == [(2, 15), (None, None)]
    assert rows_of(bad, "job_id", "publisher_id", "failed_reference") == [
        (0, 15, "job_id"),
        (1, 0, "publisher_id"),
        (9, 16, "job_id"),
    ]
    assert good.columns == ["publisher_id", "job_id"]


def test_a_check_can_bring_columns_along(spark, job):
    reference = Reference("job_id", job, "job_id", check_size=True, carry=("company_id",))
    good, bad = split_by_reference(facts(spark), reference)
    assert rows_of(good, "job_id", "company_id") == [(1, 10), (2, None), (None, None)]
    assert rows_of(bad, "job_id", "company_id") == [(0, None), (9, None)]


def test_deleted_keys_are_cleared(spark, job):
    cleared = nullify_deleted(facts(spark), Reference("job_id", job, "job_id"))
    assert rows_of(cleared, "job_id", "publisher_id") == sorted(
        [(1, 0), (2, 15), (None, None), (None, 16), (None, 15)], key=repr
    )
    assert cleared.columns == ["job_id", "publisher_id"]


def test_changed_keys_are_followed_once(spark):
    moves = spark.createDataFrame([(1, 2), (2, 3)], "old_key int, new_key int")
    moved = remap_keys(facts(spark), "job_id", moves)
    assert rows_of(moved, "job_id", "publisher_id") == sorted(
        [(2, 0), (3, 15), (None, None), (9, 16), (0, 15)], key=repr
    )


def test_broadcast_only_below_the_bound(spark):
    narrow = spark.range(100).withColumnRenamed("id", "job_id")
    big = spark.range(1000).withColumnRenamed("id", "job_id")
    hinted = big.join(sized(narrow, 100), "job_id", "left")._jdf.queryExecution().analyzed().toString()
    plain = big.join(sized(narrow, 99), "job_id", "left")._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint (strategy=broadcast)" in hinted
    assert "ResolvedHint" not in plain


@pytest.fixture
def skewed(conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )


def test_a_hot_key_is_split_when_the_join_shuffles(spark, skewed):
    """A third of the facts share one key and the dimension is too large to broadcast."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).cast("int")
    rows = spark.range(0, 300000, 1, 8).select(hot.alias("job_id"), F.col("id").alias("x"))
    dimension = spark.range(0, 200000, 1, 4).select(F.col("id").cast("int").alias("job_id"), F.lit(5).alias("company_id"))
    moves = dimension.select(F.col("job_id").alias("old_key"), F.lit(6).alias("new_key"))
    joined = [
        with_company(rows, dimension),
        split_by_reference(rows, Reference("job_id", dimension, "job_id"))[0],
        nullify_deleted(rows, Reference("job_id", dimension, "job_id")),
        remap_keys(rows, "job_id", moves),
    ]
    for frame in joined:
        frame = frame.where("x >= 0")
        frame.tail(1)
        assert "SortMergeJoin(skew=true)" in frame._jdf.queryExecution().executedPlan().toString()
    assert joined[0].count() == 300000
