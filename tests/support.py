"""Helpers of the tests that are no fixtures."""

from __future__ import annotations

from datetime import datetime, timezone

SF = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def event(kind="click", bid=1.0, job=1, ts="2025-10-01T10:30:00", publisher=15, campaign=301, group=45, **more):
    return {
        "custom_track": kind,
        "bid": bid,
        "job_id": job,
        "ts": at(ts) if ts else None,
        "publisher_id": publisher,
        "campaign_id": campaign,
        "group_id": group,
        **more,
    }


def rows_of(frame, *columns):
    return sorted((tuple(row) for row in frame.select(*columns).collect()), key=repr)
