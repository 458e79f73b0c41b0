"""Column sets of the four tables and of the change envelope."""

from __future__ import annotations

# Names, types and order are those of the tables and messages exchanged.

TRACKING = {
    "create_time": "string",
    "bid": "float",
    "bn": "string",
    "campaign_id": "int",
    "cd": "int",
    "custom_track": "string",
    "de": "string",
    "dl": "string",
    "dt": "string",
    "ed": "string",
    "ev": "int",
    "group_id": "int",
    "id": "string",
    "job_id": "int",
    "md": "string",
    "publisher_id": "int",
    "rl": "string",
    "sr": "string",
    "ts": "timestamp",
    "tz": "int",
    "ua": "string",
    "uid": "string",
    "utm_campaign": "string",
    "utm_content": "string",
    "utm_medium": "string",
    "utm_source": "string",
    "utm_term": "string",
    "v": "int",
    "vp": "string",
}

JOB = {"job_id": "int", "company_id": "int", "group_id": "int", "campaign_id": "int"}

PUBLISHER = {
    "id": "int",
    "created_by": "string",
    "created_date": "timestamp",
    "last_modified_by": "string",
    "last_modified_date": "timestamp",
    "is_active": "boolean",
    "publisher_name": "string",
    "email": "string",
    "access_token": "string",
    "publisher_type": "int",
    "publisher_status": "boolean",
    "publisher_frequency": "int",
    "curency": "int",
    "time_zone": "string",
    "cpc_increment": "int",
    "bid_reading": "int",
    "min_bid": "int",
    "max_bid": "int",
    "countries": "string",
    "data_sharing": "string",
}

EVENTS = {
    "id": "bigint",
    "job_id": "int",
    "dates": "date",
    "hours": "int",
    "disqualified_application": "bigint",
    "qualified_application": "bigint",
    "conversion": "bigint",
    "company_id": "int",
    "group_id": "int",
    "campaign_id": "int",
    "publisher_id": "int",
    "bid_set": "double",
    "clicks": "bigint",
    "spend_hour": "double",
    "sources": "string",
    "updated_at": "timestamp",
}

EVENTS_WRITTEN = [
    "job_id",
    "dates",
    "hours",
    "publisher_id",
    "campaign_id",
    "company_id",
    "group_id",
    "disqualified_application",
    "qualified_application",
    "conversion",
    "clicks",
    "bid_set",
    "spend_hour",
]

EVENTS_DEFAULTS = {"sources": "'Cassandra'", "updated_at": "current_timestamp()"}

KINDS = {
    "click": "clicks",
    "conversion": "conversion",
    "qualified": "qualified_application",
    "unqualified": "disqualified_application",
}

# End of fixed values.

HOUR_KEYS = ["job_id", "dates", "hours", "publisher_id", "campaign_id", "group_id"]

# What the rollup reads. Nested columns are not pruned out of a JSON parse, so the rollup names them.
ROLLUP_FIELDS = ["bid", "campaign_id", "custom_track", "group_id", "job_id", "publisher_id", "ts"]

# Mergeable state of one hour key: every measure of EVENTS can be computed from sums of these.
TALLY = {
    "job_id": "int",
    "dates": "date",
    "hours": "int",
    "publisher_id": "int",
    "campaign_id": "int",
    "group_id": "int",
    "n_events": "bigint",
    "clicks": "bigint",
    "bid_sum": "double",
    "bid_count": "bigint",
    "conversion": "bigint",
    "qualified_application": "bigint",
    "disqualified_application": "bigint",
}


def ddl(columns: dict[str, str], defaults: dict[str, str] | None = None) -> str:
    defaults = defaults or {}
    return ", ".join(
        f"`{name}` {kind}" + (f" DEFAULT {defaults[name]}" if name in defaults else "")
        for name, kind in columns.items()
    )


def change_ddl(fields: list[str] | None = None) -> str:
    """Parse schema of a change message, limited to ``fields`` of the changed row."""
    wire = {name: "bigint" if name == "ts" else TRACKING[name] for name in fields or TRACKING}
    after = ", ".join(f"`{name}`: {kind}" for name, kind in wire.items())
    return f"payload struct<after: struct<{after}>, op: string>"
