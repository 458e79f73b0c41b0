"""Hourly rollup as a mergeable tally.

``tally`` reduces events to one state row per hour key, ``merge`` adds state rows of
the same key, ``measures`` turns state into the published numbers. One shuffle each;
map-side partial aggregation leaves at most one row per key and task, so a key holding
a large share of the events costs the reducer no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhour.functions import is_kind
from tallyhour.schemas import HOUR_KEYS, KINDS, TALLY

# The ids of a row that count as 0 where they are missing.
ID_COLUMNS = ["job_id", "publisher_id", "group_id", "campaign_id"]


def require_job(events: DataFrame) -> DataFrame:
    return events.where(F.col("job_id").isNotNull())


def default_dims(events: DataFrame) -> DataFrame:
    """Missing ids become 0 and so form groups of their own."""
    return events.na.fill(0, subset=ID_COLUMNS)


def with_hour(events: DataFrame) -> DataFrame:
    """Calendar date and hour of ``ts`` in the session zone; a missing ``ts`` has neither."""
    return events.withColumns({"dates": F.to_date("ts"), "hours": F.hour("ts")})


def tally(events: DataFrame) -> DataFrame:
    """One state row per hour key, counting events of any kind."""
    click_bid = F.when(is_kind("click"), F.col("bid"))
    counters = [F.count_if(is_kind(kind)).alias(measure) for kind, measure in KINDS.items()]
    prepared = with_hour(default_dims(require_job(events)))
    return (
        prepared.groupBy(*HOUR_KEYS)
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.sum(click_bid).alias("bid_sum"),
            F.count(click_bid).alias("bid_count"),
            *counters,
        )
        .select(*TALLY)
    )


def merge(tallies: DataFrame) -> DataFrame:
    """Add up state rows of equal keys, however many batches they came from."""
    state = [name for name in TALLY if name not in HOUR_KEYS]
    return tallies.groupBy(*HOUR_KEYS).agg(*[F.sum(name).alias(name) for name in state])


def measures(tallies: DataFrame) -> DataFrame:
    """Published measures of state rows.

    The average counts only clicks that carry a bid. Spend is that of those clicks; with
    none it is 0 as long as some event was not a click, and unknown otherwise.
    """
    spend = F.when(F.col("bid_count") > 0, F.col("bid_sum")).when(F.col("n_events") > F.col("clicks"), F.lit(0.0))
    return tallies.withColumns(
        {"bid_set": F.try_divide("bid_sum", "bid_count"), "spend_hour": spend}
    ).drop("n_events", "bid_sum", "bid_count")


def hourly(events: DataFrame) -> DataFrame:
    return measures(tally(events))
