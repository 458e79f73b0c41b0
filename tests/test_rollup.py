from __future__ import annotations

import math
from collections import defaultdict
from datetime import date

import pytest
from support import SF_ORACLE, event, rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyhour.operators.enrich import with_company
from tallyhour.operators.contract import to_events_contract
from tallyhour.operators.rollup import default_dims, hourly, measures, merge, require_job, tally
from tallyhour.plans import inputs
from tallyhour.schemas import EVENTS_WRITTEN, HOUR_KEYS
from pyspark.sql import functions as F

COUNTS = ["clicks", "conversion", "qualified_application", "disqualified_application"]


def one(frame):
    (row,) = frame.collect()
    return row


def test_rows_without_a_job_are_dropped_not_filled(tracking):
    raw = tracking(event(job=None), event(job=0))
    assert rows_of(hourly(raw), "job_id", "clicks") == [(0, 1)]
    assert require_job(raw).count() == 1


def test_missing_ids_become_zero_and_group_together(tracking):
    raw = tracking(
        event(publisher=None, campaign=None, group=None),
        event(publisher=0, campaign=0, group=0),
        event(publisher=1, campaign=None, group=2),
    )
    assert rows_of(hourly(raw), "publisher_id", "campaign_id", "group_id", "clicks") == [(0, 0, 0, 2), (1, 0, 2, 1)]
    assert default_dims(raw).where("publisher_id IS NULL").count() == 0


@pytest.mark.parametrize("kind", ["view", None, "Click", " click", "CLICK", ""])
def test_unknown_kinds_make_a_group_of_zeros(tracking, kind):
    row = one(hourly(tracking(event(kind=kind))))
    assert [row[name] for name in COUNTS] == [0, 0, 0, 0]
    assert row.bid_set is None
    assert row.spend_hour == 0.0


def test_each_kind_feeds_its_counter(tracking):
    raw = tracking(*[event(kind=k, bid=None) for k in ("click", "conversion", "conversion", "qualified", "unqualified")])
    row = one(hourly(raw))
    assert [row[name] for name in COUNTS] == [1, 2, 1, 1]


def test_clicks_without_bid(tracking):
    alone = one(hourly(tracking(event(bid=None))))
    assert (alone.clicks, alone.bid_set, alone.spend_hour) == (1, None, None)
    with_view = one(hourly(tracking(event(bid=None), event(kind="view", bid=9.0))))
    assert (with_view.clicks, with_view.bid_set, with_view.spend_hour) == (1, None, 0.0)
    some = one(hourly(tracking(event(bid=0.1), event(bid=None))))
    assert (some.clicks, some.bid_set, some.spend_hour) == (2, 0.10000000149011612, 0.10000000149011612)


def test_bids_of_other_kinds_do_not_count(tracking):
    row = one(hourly(tracking(event(bid=2.0), event(kind="conversion", bid=50.0))))
    assert (row.bid_set, row.spend_hour) == (2.0, 2.0)


def test_nan_bid_spreads_over_its_group_only(tracking):
    raw = tracking(event(bid=float("nan")), event(bid=1.0), event(bid=1.0, job=2))
    by_job = {row.job_id: row for row in hourly(raw).collect()}
    assert math.isnan(by_job[1].bid_set) and math.isnan(by_job[1].spend_hour)
    assert by_job[2].spend_hour == 1.0


def test_missing_ts_gives_missing_hour(tracking):
    assert rows_of(hourly(tracking(event(ts=None))), "dates", "hours", "clicks") == [(None, None, 1)]


def test_midnight_splits_dates(tracking):
    raw = tracking(event(ts="2025-10-01T23:59:59.999"), event(ts="2025-10-02T00:00:00"))
    assert rows_of(hourly(raw), "dates", "hours") == [(date(2025, 10, 1), 23), (date(2025, 10, 2), 0)]


def test_hours_follow_the_session_zone(tracking, conf):
    raw = tracking(event(ts="2025-10-01T20:45:00"))
    conf(spark__sql__session__timeZone="Asia/Kolkata")
    assert rows_of(hourly(raw), "dates", "hours") == [(date(2025, 10, 2), 2)]


# The published sample rows.
SAMPLE = [
    # job, date, hour, unqualified, qualified, conversion, company, group, campaign, publisher, bid, clicks, spend
    (2050, "2025-10-01", 10, 5, 20, 3, 1, 45, 301, 15, 0.50, 120, 60.00),
    (2051, "2025-10-01", 11, 2, 10, 0, 1, 45, 302, 15, 0.00, 350, 0.00),
    (2052, "2025-10-02", 14, 0, 5, 1, 2, 50, 405, 22, 1.25, 40, 50.00),
    (2053, "2025-10-02", 15, 15, 50, 5, 1, 48, 301, 15, 0.75, 250, 187.50),
]


def test_sample_rows_from_raw_events(spark, tracking):
    raw, jobs = [], []
    for job, day, hour, unqualified, qualified, conversion, company, group, campaign, publisher, bid, clicks, _ in SAMPLE:
        common = dict(job=job, ts=f"{day}T{hour:02d}:15:00", publisher=publisher, campaign=campaign, group=group)
        raw += [event(bid=bid, **common)] * clicks
        for kind, n in (("unqualified", unqualified), ("qualified", qualified), ("conversion", conversion)):
            raw += [event(kind=kind, bid=None, **common)] * n
        jobs.append((job, company, 99, 98))
    job = spark.createDataFrame(jobs, "job_id int, company_id int, group_id int, campaign_id int")
    written = to_events_contract(with_company(hourly(tracking(*raw)), job))
    got = rows_of(
        written.withColumn("dates", F.col("dates").cast("string")),
        "job_id", "dates", "hours", "disqualified_application", "qualified_application", "conversion", "company_id",
        "group_id", "campaign_id", "publisher_id", "bid_set", "clicks", "spend_hour",
    )
    assert got == SAMPLE
    assert written.columns == [*EVENTS_WRITTEN, "updated_at"]


def brute_force(events):
    groups = defaultdict(list)
    for e in events:
        if e["job_id"] is None:
            continue
        hour = (e["ts"].date(), e["ts"].hour) if e["ts"] else (None, None)
        groups[(e["job_id"], *hour, e["publisher_id"] or 0, e["campaign_id"] or 0, e["group_id"] or 0)].append(e)
    out = {}
    for key, members in groups.items():
        clicks = [e for e in members if e["custom_track"] == "click"]
        bids = [e["bid"] for e in clicks if e["bid"] is not None]
        spend = sum(bids) if bids else (0.0 if len(members) > len(clicks) else None)
        kinds = [e["custom_track"] for e in members]
        out[key] = (
            len(clicks),
            sum(bids) / len(bids) if bids else None,
            spend,
            kinds.count("conversion"),
            kinds.count("qualified"),
            kinds.count("unqualified"),
        )
    return out


EVENTS = st.lists(
    st.builds(
        event,
        kind=st.sampled_from(["click", "click", "conversion", "qualified", "unqualified", "view", None]),
        bid=st.sampled_from([None, 0.0, 0.5, 1.25, 3.75]),
        job=st.sampled_from([None, 1, 2]),
        ts=st.sampled_from([None, "2025-10-01T23:59:59", "2025-10-02T00:00:00"]),
        publisher=st.sampled_from([None, 0, 7]),
        campaign=st.sampled_from([None, 3]),
        group=st.sampled_from([None, 4]),
    ),
    min_size=1,
    max_size=30,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events=EVENTS, cuts=st.integers(1, 4))
def test_any_split_merges_to_the_whole(tracking, events, cuts):
    expected = brute_force(events)
    raw = tracking(*events)
    whole = {tuple(r[k] for k in HOUR_KEYS): r for r in hourly(raw).collect()}
    parts = [raw.where(F.pmod(F.xxhash64("create_time"), F.lit(cuts)) == n) for n in range(cuts)]
    tallies = tally(parts[0])
    for part in parts[1:]:
        tallies = tallies.unionByName(tally(part))
    merged = {tuple(r[k] for k in HOUR_KEYS): r for r in measures(merge(tallies)).collect()}
    for got in (whole, merged):
        assert {
            k: (r.clicks, r.bid_set, r.spend_hour, r.conversion, r.qualified_application, r.disqualified_application)
            for k, r in got.items()
        } == expected


def test_averaging_averages_would_differ(tracking):
    """Why state carries sums and counts: the mean of batch means is another number."""
    first, second = tracking(event(bid=1.0), event(bid=1.0)), tracking(event(bid=4.0))
    merged = one(measures(merge(tally(first).unionByName(tally(second)))))
    assert merged.bid_set == 2.0


def test_known_totals_of_the_sample_tables(spark):
    facts = hourly(inputs.tracking(spark, SF_ORACLE)).cache()
    total = one(
        facts.agg(
            F.count("*").alias("n"),
            *[F.sum(name).alias(name) for name in COUNTS],
            F.round(F.sum("spend_hour"), 2).alias("spend"),
            F.count_if(F.col("bid_set").isNull()).alias("no_bid"),
            F.count_if(F.col("spend_hour").isNull()).alias("no_spend"),
            F.count_if(sum((F.col(name) for name in COUNTS), F.lit(0)) == 0).alias("idle"),
        )
    )
    assert (total.n, *[total[name] for name in COUNTS]) == (5399, 1977, 1946, 1967, 1969)
    assert (total.spend, total.no_bid, total.no_spend, total.idle) == (93876.36, 3798, 45, 591)
    facts.unpersist()
