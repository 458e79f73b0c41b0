"""Expected results of the registered queries, as SQL over the sample tables.

Written from the rules of the pipeline, without its tallies: measures are plain
conditional aggregates over events, references are EXISTS tests.
"""

from __future__ import annotations

_TRACKING = """
tracking AS (
  SELECT CAST(event_id AS VARCHAR) AS create_time,
         CAST(CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id % 8 END AS INTEGER) AS job_id,
         ts,
         CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'conversion'
              WHEN 'signup' THEN 'qualified' WHEN 'error' THEN 'unqualified' ELSE event_type END AS custom_track,
         CAST(CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS FLOAT) AS bid,
         CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 2 + 1 END AS INTEGER) AS publisher_id,
         CAST(user_id % 4 AS INTEGER) AS campaign_id,
         CAST(user_id % 2 AS INTEGER) AS group_id,
         CAST(user_id AS VARCHAR) AS uid,
         props AS ed
  FROM events)"""

_DIMENSIONS = """
job AS (SELECT CAST(c_custkey + 2 AS INTEGER) AS job_id, CAST(c_nationkey AS INTEGER) AS company_id FROM customer),
publisher AS (SELECT CAST(s_suppkey + 2 AS INTEGER) AS id, s_name AS publisher_name FROM supplier)"""

_FACTS = """
facts AS (
  SELECT job_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS dates, CAST(hour(ts) AS INTEGER) AS "hours",
         COALESCE(publisher_id, 0) AS publisher_id, COALESCE(campaign_id, 0) AS campaign_id,
         COALESCE(group_id, 0) AS group_id,
         CAST(SUM(CASE WHEN custom_track = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
         ROUND(AVG(CASE WHEN custom_track = 'click' THEN CAST(bid AS DOUBLE) END), 4) AS bid_set,
         ROUND(SUM(CASE WHEN custom_track = 'click' THEN CAST(bid AS DOUBLE) ELSE 0 END), 4) AS spend_hour,
         CAST(SUM(CASE WHEN custom_track = 'conversion' THEN 1 ELSE 0 END) AS BIGINT) AS conversion,
         CAST(SUM(CASE WHEN custom_track = 'qualified' THEN 1 ELSE 0 END) AS BIGINT) AS qualified_application,
         CAST(SUM(CASE WHEN custom_track = 'unqualified' THEN 1 ELSE 0 END) AS BIGINT) AS disqualified_application
  FROM tracking WHERE job_id IS NOT NULL
  GROUP BY ALL)"""

_KEYS = 'job_id, dates, "hours", publisher_id, campaign_id, group_id'
_MEASURES = "clicks, bid_set, spend_hour, conversion, qualified_application, disqualified_application"
_WRITTEN = (
    'job_id, dates, "hours", publisher_id, campaign_id, company_id, group_id, disqualified_application, '
    "qualified_application, conversion, clicks, bid_set, spend_hour"
)
_RAW = (
    "create_time, job_id, epoch_us(ts) // 1000 AS ts_millis, custom_track, ROUND(CAST(bid AS DOUBLE), 4) AS bid, "
    "publisher_id, campaign_id, group_id, uid, ed"
)


def _raw(select: str, rest: str = "") -> str:
    return f"WITH {_TRACKING} SELECT {select} FROM tracking {rest}"


def _facts(select: str, rest: str = "") -> str:
    return f"WITH {_TRACKING}, {_DIMENSIONS}, {_FACTS} SELECT {select} FROM facts f {rest}"


_KNOWN_JOB = "EXISTS (SELECT 1 FROM job j WHERE j.job_id = f.job_id)"
_KNOWN_PUBLISHER = "EXISTS (SELECT 1 FROM publisher p WHERE p.id = f.publisher_id)"
_ADDED_UP = "clicks, spend_hour, conversion, qualified_application, disqualified_application"
_COMPANY = "LEFT JOIN (SELECT job_id AS known_job, company_id FROM job) ON known_job = f.job_id"

# Column, type and filled-row count of the created tables.
_TRACKING_COLUMNS = {
    "create_time": ("string", "event_id"),
    "bid": ("float", "CASE WHEN event_id % 13 <> 0 THEN value END"),
    "bn": ("string", None),
    "campaign_id": ("int", "user_id"),
    "cd": ("int", None),
    "custom_track": ("string", "event_type"),
    "de": ("string", None),
    "dl": ("string", None),
    "dt": ("string", None),
    "ed": ("string", "props"),
    "ev": ("int", None),
    "group_id": ("int", "user_id"),
    "id": ("string", None),
    "job_id": ("int", "CASE WHEN event_id % 50 <> 0 THEN user_id END"),
    "md": ("string", None),
    "publisher_id": ("int", "CASE WHEN event_id % 11 <> 0 THEN user_id END"),
    "rl": ("string", None),
    "sr": ("string", None),
    "ts": ("timestamp", "ts"),
    "tz": ("int", None),
    "ua": ("string", None),
    "uid": ("string", "user_id"),
    "utm_campaign": ("string", None),
    "utm_content": ("string", None),
    "utm_medium": ("string", None),
    "utm_source": ("string", None),
    "utm_term": ("string", None),
    "v": ("int", None),
    "vp": ("string", None),
}
_JOB_COLUMNS = {
    "job_id": ("int", "c_custkey"),
    "company_id": ("int", "c_nationkey"),
    "group_id": ("int", "1"),
    "campaign_id": ("int", "1"),
}
_PUBLISHER_COLUMNS = {
    "id": ("int", "s_suppkey"),
    "created_by": ("string", None),
    "created_date": ("timestamp", None),
    "last_modified_by": ("string", None),
    "last_modified_date": ("timestamp", None),
    "is_active": ("boolean", None),
    "publisher_name": ("string", "s_name"),
    "email": ("string", None),
    "access_token": ("string", None),
    "publisher_type": ("int", None),
    "publisher_status": ("boolean", None),
    "publisher_frequency": ("int", None),
    "curency": ("int", None),
    "time_zone": ("string", None),
    "cpc_increment": ("int", None),
    "bid_reading": ("int", None),
    "min_bid": ("int", None),
    "max_bid": ("int", None),
    "countries": ("string", None),
    "data_sharing": ("string", None),
}
_EVENTS_COLUMNS = {
    "id": ("bigint", "1"),
    "job_id": ("int", "job_id"),
    "dates": ("date", "dates"),
    "hours": ("int", '"hours"'),
    "disqualified_application": ("bigint", "disqualified_application"),
    "qualified_application": ("bigint", "qualified_application"),
    "conversion": ("bigint", "conversion"),
    "company_id": ("int", "company_id"),
    "group_id": ("int", "group_id"),
    "campaign_id": ("int", "campaign_id"),
    "publisher_id": ("int", "publisher_id"),
    "bid_set": ("double", "bid_set"),
    "clicks": ("bigint", "clicks"),
    "spend_hour": ("double", "spend_hour"),
    "sources": ("string", "1"),
    "updated_at": ("timestamp", "1"),
}


def _described(table: str, columns: dict, source: str) -> list[str]:
    return [
        f"SELECT '{table}' AS table_name, '{name}' AS column_name, '{kind}' AS column_type, "
        f"CAST(COUNT({filled or 'NULL'}) AS BIGINT) AS filled FROM {source}"
        for name, (kind, filled) in columns.items()
    ]


def _stored_tables() -> str:
    parts = (
        _described("tracking", _TRACKING_COLUMNS, "events")
        + _described("job", _JOB_COLUMNS, "customer")
        + _described("master_publisher", _PUBLISHER_COLUMNS, "supplier")
        + _described("events", _EVENTS_COLUMNS, "enriched")
    )
    enriched = f"enriched AS (SELECT {_WRITTEN} FROM facts f {_COMPANY})"
    return f"WITH {_TRACKING}, {_DIMENSIONS}, {_FACTS}, {enriched} " + " UNION ALL ".join(parts)


def _cursor_rules() -> str:
    rows, empty = "2024-01-15 00:00:00", "2024-01-31 12:00:00"
    poll = "TIMESTAMP '2024-02-01 00:00:00'"
    cases = []
    for scan, cursor in (("rows", rows), ("empty", empty)):
        for rule, fallback in (("safe", f"TIMESTAMP '{cursor}'"), ("strict", poll)):
            cases.append(
                f"SELECT '{scan}' AS scan, '{rule}' AS rule, epoch_us(COALESCE(MAX(ts), {fallback})) AS next_micros, "
                f"CAST(COUNT(*) AS BIGINT) AS sent FROM events WHERE ts > TIMESTAMP '{cursor}'"
            )
    return " UNION ALL ".join(cases)


def _increments_by_span() -> str:
    return """
    WITH s0 AS (SELECT MAX(ts) AS c, COUNT(*) AS n FROM events
                WHERE ts <= (SELECT MIN(ts) FROM events) + INTERVAL 10 DAY),
         s1 AS (SELECT MAX(ts) AS c, COUNT(*) AS n FROM events
                WHERE ts > (SELECT c FROM s0)
                  AND ts <= (SELECT MIN(ts) FROM events WHERE ts > (SELECT c FROM s0)) + INTERVAL 10 DAY),
         s2 AS (SELECT MAX(ts) AS c, COUNT(*) AS n FROM events
                WHERE ts > (SELECT c FROM s1)
                  AND ts <= (SELECT MIN(ts) FROM events WHERE ts > (SELECT c FROM s1)) + INTERVAL 10 DAY)
    SELECT CAST(0 AS INTEGER) AS step, epoch_us(c) AS cursor_micros, CAST(n AS BIGINT) AS sent FROM s0
    UNION ALL SELECT 1, epoch_us(c), CAST(n AS BIGINT) FROM s1
    UNION ALL SELECT 2, epoch_us(c), CAST(n AS BIGINT) FROM s2"""


def oracle_sql() -> dict[str, str]:
    whole_rollup = _facts(f"{_KEYS}, {_MEASURES}")
    whole_raw = _raw(_RAW)
    return {
        "hourly_rollup": whole_rollup,
        "clicks_by_hour": _facts(f"{_KEYS}, clicks"),
        "bid_set_by_hour": _facts(f"{_KEYS}, bid_set"),
        "spend_by_hour": _facts(f"{_KEYS}, spend_hour"),
        "conversions_by_hour": _facts(f"{_KEYS}, conversion"),
        "qualified_by_hour": _facts(f"{_KEYS}, qualified_application"),
        "disqualified_by_hour": _facts(f"{_KEYS}, disqualified_application"),
        "kind_flags": _raw(
            "create_time, custom_track, "
            + ", ".join(
                f"CAST(COALESCE(custom_track = '{kind}', FALSE) AS INTEGER) AS is_{kind}"
                for kind in ("click", "conversion", "qualified", "unqualified")
            )
        ),
        "default_dims": _raw(
            "create_time, job_id, COALESCE(publisher_id, 0) AS publisher_id, COALESCE(group_id, 0) AS group_id, "
            "COALESCE(campaign_id, 0) AS campaign_id",
            "WHERE job_id IS NOT NULL",
        ),
        "require_job": _raw("create_time, job_id", "WHERE job_id IS NOT NULL"),
        "event_hour_keys": _raw(
            'create_time, CAST(CAST(ts AS DATE) AS VARCHAR) AS dates, CAST(hour(ts) AS INTEGER) AS "hours"'
        ),
        "millis_round_trip": _raw(
            "create_time, epoch_us(ts) // 1000 AS ts_millis, epoch_us(ts) // 1000 * 1000 AS back_micros, "
            "CAST(hour(ts) AS INTEGER) AS back_hour"
        ),
        "rollup_with_company": _facts(f"{_KEYS}, company_id, {_MEASURES}", _COMPANY),
        "events_written": _facts(_WRITTEN, _COMPANY),
        "events_contract": _facts(
            f"ROW_NUMBER() OVER (ORDER BY {_KEYS}) AS id, {_WRITTEN}, 'Cassandra' AS sources", _COMPANY
        ),
        "stored_job_dimension": f"WITH {_DIMENSIONS} SELECT job_id, company_id, CAST(99 AS INTEGER) AS group_id, "
        "CAST(98 AS INTEGER) AS campaign_id FROM job",
        "reference_ok_job": _facts(f"{_KEYS}, clicks", f"WHERE {_KNOWN_JOB}"),
        "reference_bad_job": _facts(f"{_KEYS}, clicks", f"WHERE NOT {_KNOWN_JOB}"),
        "reference_ok_publisher": _facts(f"{_KEYS}, clicks", f"WHERE {_KNOWN_PUBLISHER}"),
        "reference_bad_publisher": _facts(f"{_KEYS}, clicks", f"WHERE NOT {_KNOWN_PUBLISHER}"),
        "reference_failures": _facts(
            f"{_KEYS}, CONCAT_WS(',', CASE WHEN NOT {_KNOWN_JOB} THEN 'job_id' END, "
            f"CASE WHEN NOT {_KNOWN_PUBLISHER} THEN 'publisher_id' END) AS failed_reference",
            f"WHERE NOT ({_KNOWN_JOB} AND {_KNOWN_PUBLISHER})",
        ),
        "reference_raw_publisher": f"WITH {_TRACKING}, {_DIMENSIONS} SELECT create_time, publisher_id FROM tracking f "
        f"WHERE publisher_id IS NULL OR {_KNOWN_PUBLISHER}",
        "nullify_deleted_jobs": _facts(
            f"CASE WHEN {_KNOWN_JOB} THEN job_id END AS job_id, {_KEYS.removeprefix('job_id, ')}, clicks"
        ),
        "nullify_deleted_publishers": _facts(
            f'job_id, dates, "hours", CASE WHEN {_KNOWN_PUBLISHER} THEN publisher_id END AS publisher_id, '
            "campaign_id, group_id, clicks"
        ),
        "remap_job_keys": _facts(
            f"CASE WHEN {_KNOWN_JOB} THEN job_id + 1000 ELSE job_id END AS job_id, "
            f"{_KEYS.removeprefix('job_id, ')}, clicks"
        ),
        "remap_publisher_keys": _facts(
            f'job_id, dates, "hours", CASE WHEN {_KNOWN_PUBLISHER} THEN publisher_id + 1000 ELSE publisher_id END '
            "AS publisher_id, campaign_id, group_id, clicks"
        ),
        "envelope_build": _raw(
            f"{_RAW}, CAST(29 AS INTEGER) AS n_fields, 'r' AS op, "
            "CAST(1 AS INTEGER) AS has_capture_time"
        ),
        "envelope_parse": whole_raw,
        "bad_records_dropped": _raw(
            "create_time, job_id, custom_track, "
            "CASE WHEN CAST(create_time AS BIGINT) % 10 = 7 THEN NULL ELSE ROUND(CAST(bid AS DOUBLE), 4) END AS bid, "
            "epoch_us(ts) // 1000 AS ts_millis",
            "WHERE job_id IS NOT NULL AND CAST(create_time AS BIGINT) % 10 >= 7",
        ),
        "dead_letters": """
            SELECT CASE event_id % 10 WHEN 0 THEN 'not a message' WHEN 1 THEN 'no payload' WHEN 2 THEN 'no bytes' WHEN 3 THEN 'no row'
                        WHEN 4 THEN 'job unreadable' WHEN 5 THEN 'job unreadable' WHEN 6 THEN 'job unreadable'
                        ELSE 'read' END AS reason,
                   CAST(COUNT(*) AS BIGINT) AS n_messages,
                   CAST(COUNT(*) FILTER (WHERE event_id % 10 IN (0, 1, 3, 4, 5, 6)) AS BIGINT) AS n_with_bytes
            FROM events GROUP BY 1""",
        "stream_dead_letters": """
            SELECT 'dead' AS kind, CAST(COUNT(*) AS BIGINT) AS n FROM events WHERE event_id % 10 < 7
            UNION ALL SELECT 'counted', CAST(COUNT(*) AS BIGINT) FROM events WHERE event_id % 10 >= 7 AND event_id % 50 <> 0""",
        "publish_and_read_back": whole_raw,
        "incremental_scan": _raw(_RAW, "WHERE ts > TIMESTAMP '2024-01-15 00:00:00'"),
        "snapshot_scan": _raw("create_time, job_id, epoch_us(ts) // 1000 AS ts_millis, 'r' AS op", "WHERE ts IS NOT NULL"),
        "bounded_scan": _raw(
            "create_time, epoch_us(ts) // 1000 AS ts_millis",
            "WHERE ts > TIMESTAMP '2024-01-14 18:00:00' AND ts <= TIMESTAMP '2024-01-20 10:00:00'",
        ),
        "op_code": "SELECT 'r' AS op, CAST(COUNT(*) AS BIGINT) AS n_messages FROM events UNION ALL "
        "SELECT 'c', CAST(COUNT(*) AS BIGINT) FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'",
        "next_cursor": _cursor_rules(),
        "scan_count": "SELECT CAST(COUNT(*) AS BIGINT) AS sent FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'",
        "cursor_text_round_trip": _raw(
            "create_time, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS cursor_text, epoch_us(ts) AS cursor_micros"
        ),
        "cursor_round_trip": whole_raw,
        "late_rows_captured": whole_raw,
        "late_rows_sent_once": whole_raw,
        "lateness_quantiles": """
            WITH late AS (SELECT ((event_id * 7919) % 10007) * ((event_id * 7919) % 10007) AS ms FROM events WHERE ts IS NOT NULL),
                 ranked AS (SELECT ms, row_number() OVER (ORDER BY ms) AS place, count(*) OVER () AS n FROM late),
                 asked AS (SELECT unnest([0.5, 0.9, 0.99, 0.999])::DOUBLE AS share),
                 found AS (SELECT share, ms FROM asked JOIN ranked ON place = greatest(1, ceil(share * n)))
            SELECT share, CASE WHEN ms <= 0 THEN 0.0
                   ELSE round(2 * pow(1.01 / 0.99, ceil(ln(ms) / ln(1.01 / 0.99))) / (1.01 / 0.99 + 1), 3) END AS late_ms
            FROM found""",
        "op_code_by_span": "SELECT 'r' AS op, CAST(COUNT(*) AS BIGINT) AS n_messages FROM events",
        "increments_by_span": _increments_by_span(),
        "stored_cursor": "SELECT epoch_us(MAX(ts)) AS cursor_micros, "
        "CAST(COUNT(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') AS BIGINT) AS first_sent, "
        "CAST(COUNT(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15 00:00:00') AS BIGINT) AS second_sent FROM events",
        "deduped_changes": whole_raw,
        "conflicting_changes": "SELECT CAST(event_id AS VARCHAR) AS create_time, CAST(3 AS BIGINT) AS n_copies "
        "FROM events WHERE event_id % 7 = 0",
        "stream_parse": whole_raw,
        "stream_publish": whole_raw,
        "stream_deltas_compacted": whole_rollup,
        "stream_replay_idempotent": whole_rollup,
        "stream_deduped": whole_rollup,
        "compacted_table": whole_rollup,
        "compacted_two_streams": whole_rollup,
        "two_streams_one_table": whole_rollup,
        "empty_batches_under_dedup": whole_rollup,
        "stream_events_appended": _facts(
            f"{_KEYS}, company_id, {_ADDED_UP}", f"{_COMPANY} WHERE {_KNOWN_JOB} AND {_KNOWN_PUBLISHER}"
        ),
        "stream_events_quarantined": _facts(
            f"{_KEYS}, CONCAT_WS(',', CASE WHEN NOT {_KNOWN_JOB} THEN 'job_id' END, "
            f"CASE WHEN NOT {_KNOWN_PUBLISHER} THEN 'publisher_id' END) AS failed_reference, {_ADDED_UP}",
            f"WHERE NOT ({_KNOWN_JOB} AND {_KNOWN_PUBLISHER})",
        ),
        "table_append_with_defaults": _facts(f"{_WRITTEN}, 'Cassandra' AS sources", _COMPANY),
        "readmitted_after_growth": _facts(
            f"{_KEYS}, company_id, {_ADDED_UP}, NULLIF(CONCAT_WS(',', CASE WHEN NOT {_KNOWN_JOB} THEN 'job_id' END, "
            f"CASE WHEN NOT {_KNOWN_PUBLISHER} THEN 'publisher_id' END), '') AS failed_reference",
            _COMPANY,
        ),
        "stored_nullify_jobs": _facts(
            _WRITTEN.replace("job_id,", f"CASE WHEN {_KNOWN_JOB} THEN job_id END AS job_id,", 1), _COMPANY
        ),
        "stored_remap_publishers": _facts(
            _WRITTEN.replace(
                "publisher_id,", "CASE publisher_id WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE publisher_id END AS publisher_id,", 1
            ),
            _COMPANY,
        ),
        "company_backfilled": _facts(_WRITTEN, _COMPANY),
        "company_as_of": _facts(
            f"{_KEYS}, CASE WHEN job_id % 2 = 0 AND CAST(dates AS TIMESTAMP) + to_hours(\"hours\") >= "
            "TIMESTAMP '2024-01-15 12:00:00' THEN company_id + 100 ELSE company_id END AS company_id, clicks",
            _COMPANY,
        ),
        "ids_reserved": _facts(f"{_WRITTEN}, 'Cassandra' AS sources", _COMPANY),
        "append_after_partial_failure": _facts(_WRITTEN, _COMPANY),
        "append_once_two_streams": _facts(_WRITTEN, _COMPANY),
        "events_contract_appended": _facts(f"{_WRITTEN}, 'Cassandra' AS sources", _COMPANY),
        "stored_tables": _stored_tables(),
    }
