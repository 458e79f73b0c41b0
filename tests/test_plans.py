"""Physical plans of the main queries: what is read, pushed and shuffled."""

from __future__ import annotations

import re

from support import SF

from tallyhour.operators.contract import with_ids
from tallyhour.operators.rollup import hourly
from tallyhour.plans import inputs
from tallyhour.plans.queries import queries


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rollup_shuffles_once_after_partial_aggregation(spark):
    text = plan(hourly(inputs.tracking(spark, SF)))
    assert text.count("Exchange") == 1
    assert text.count("HashAggregate") == 2
    assert "SortAggregate" not in text


def test_rollup_reads_only_its_columns(spark):
    schema = re.search(r"ReadSchema: (\S+)", plan(hourly(inputs.tracking(spark, SF)))).group(1)
    assert "props" not in schema


def test_unused_measures_are_not_computed(spark):
    text = plan(queries()["clicks_by_hour"](spark, SF))
    assert "bid" not in text and "value" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_company_join_reads_two_columns(spark):
    text = plan(queries()["rollup_with_company"](spark, SF))
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in text


def test_large_dimension_is_shuffled_not_broadcast(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(queries()["rollup_with_company"](spark, SF))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_capture_and_envelopes_do_not_shuffle(spark):
    for name in ("incremental_scan", "snapshot_scan", "envelope_build", "envelope_parse", "kind_flags", "default_dims"):
        assert "Exchange" not in plan(queries()[name](spark, SF)), name


def test_no_python_workers_and_no_cartesian_products(spark):
    for name in ("events_written", "events_contract", "reference_failures", "deduped_changes", "bad_records_dropped"):
        text = plan(queries()[name](spark, SF))
        assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text, name


def test_only_partition_sizes_reach_a_single_task(spark):
    frame = with_ids(spark.range(100).withColumnRenamed("id", "k"), ["k"])
    text = plan(frame)
    single = text[text.index("Exchange SinglePartition") :]
    assert "HashAggregate(keys=[_part" in single.splitlines()[1]
