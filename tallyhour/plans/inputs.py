"""The library's tables, derived from the whole sample tables.

Jobs 0 and 1 and publishers 0 and 1 are missing from the dimensions on purpose, so that
every join and reference check meets rows without a partner. The dimensions carry a group
and a campaign no event has, so that a leak of either would show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhour.schemas import JOB, PUBLISHER, TRACKING

# Reading ts as an instant, rather than casting it, lets bounds on it reach the scan.
_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"

_KIND_OF = {"click": "click", "purchase": "conversion", "signup": "qualified", "error": "unqualified"}


def _fill(columns: dict[str, str], known: dict[str, str]) -> list[str]:
    return [f"CAST({known.get(name, 'NULL')} AS {kind}) AS `{name}`" for name, kind in columns.items()]


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")
    kinds = " ".join(f"WHEN '{name}' THEN '{kind}'" for name, kind in _KIND_OF.items())
    known = {
        "create_time": "event_id",
        "job_id": "CASE WHEN event_id % 50 <> 0 THEN user_id % 8 END",
        "ts": "ts",
        "custom_track": f"CASE event_type {kinds} ELSE event_type END",
        "bid": "CASE WHEN event_id % 13 <> 0 THEN value END",
        "publisher_id": "CASE WHEN event_id % 11 <> 0 THEN user_id % 2 + 1 END",
        "campaign_id": "user_id % 4",
        "group_id": "user_id % 2",
        "uid": "user_id",
        "ed": "props",
    }
    return events.selectExpr(*_fill(TRACKING, known))


def job(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"job_id": "c_custkey + 2", "company_id": "c_nationkey", "group_id": "99", "campaign_id": "98"}
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*_fill(JOB, known))


def publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"id": "s_suppkey + 2", "publisher_name": "s_name"}
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(*_fill(PUBLISHER, known))
