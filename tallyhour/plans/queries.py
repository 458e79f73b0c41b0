"""One query per operator, over the whole sample tables.

Results are made comparable across engines: dates as text, timestamps as epoch counts,
averages and sums rounded to four digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from math import ceil

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhour.functions import EPOCH, iso_text, is_kind, millis, op_code, parse_iso, saturating_instant
from tallyhour.operators.capture import incremental_scan, next_cursor
from tallyhour.operators.contract import events_rows, last_id, to_events_contract
from tallyhour.operators.dedup import conflicting_changes, distinct_changes
from tallyhour.operators.enrich import with_company, with_company_as_of
from tallyhour.operators.envelope import dead_letters, living, read_changes, read_or_refuse, to_envelope
from tallyhour.operators.integrity import Reference, nullify_deleted, remap_keys, split_by_reference
from tallyhour.operators.lateness import lateness_quantiles, lateness_sketch, merge_sketches
from tallyhour.operators.rollup import ID_COLUMNS, default_dims, hourly, require_job, with_hour
from tallyhour.plans import inputs
from tallyhour.plans.batch import deliver, hourly_events
from tallyhour.plans.capture import run_increment
from tallyhour.plans.maintenance import backfill_company, nullify_stored, remap_stored
from tallyhour.plans.readmission import readmit, still_refused
from tallyhour.schemas import EVENTS, EVENTS_WRITTEN, HOUR_KEYS, JOB, ROLLUP_FIELDS, TRACKING
from tallyhour.session import for_state, pin_utc, scratch
from tallyhour.sinks.batches import BatchTable, compact, published, tally_table
from tallyhour.sinks.compaction import compact_batches, compacted_table as dated_tallies, expire_batches, served
from tallyhour.sinks.cursor import CursorTable
from tallyhour.sinks.dated import DatedTable
from tallyhour.sinks.ids import IdRanges
from tallyhour.sinks.jdbc import append_once
from tallyhour.sinks.ledger import SentLedger
from tallyhour.sinks.tables import DEFINITIONS, create_all, create_table, table_append
from tallyhour.sinks.topic import publish
from tallyhour.sources.dimension import stored_dimension
from tallyhour.sources.topic import topic_stream
from tallyhour.streaming.capture import publish_stream
from tallyhour.streaming.rollup import run_to_end

Query = Callable[[SparkSession, str], DataFrame]

CURSOR = "2024-01-15T00:00:00Z"
POLL_START = "2024-02-01T00:00:00Z"
MEASURES = [
    "clicks",
    "bid_set",
    "spend_hour",
    "conversion",
    "qualified_application",
    "disqualified_application",
]
RAW = ["create_time", "job_id", "ts", "custom_track", "bid", "publisher_id", "campaign_id", "group_id", "uid", "ed"]
FACT = {name: EVENTS[name] for name in [*EVENTS_WRITTEN, "updated_at"]}

_REGISTRY: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    """Register under the function's name; a trailing underscore sets it apart from an operator."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(pin_utc(spark), sf_dir)

    _REGISTRY[fn.__name__.strip("_")] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _comparable(name: str) -> Column:
    if name == "dates":
        return F.col("dates").cast("string").alias("dates")
    if name in ("bid_set", "spend_hour", "bid"):
        return F.round(F.col(name).cast("double"), 4).alias(name)
    if name == "ts":
        return millis(F.col("ts")).alias("ts_millis")
    return F.col(name)


def _shown(frame: DataFrame, names: list[str]) -> DataFrame:
    return frame.select(*[_comparable(name) for name in names])


# Rollup


@_query
def hourly_rollup(spark, sf_dir):
    return _shown(hourly(inputs.tracking(spark, sf_dir)), HOUR_KEYS + MEASURES)


def _one_measure(spark, sf_dir, measure):
    return _shown(hourly(inputs.tracking(spark, sf_dir)), [*HOUR_KEYS, measure])


@_query
def clicks_by_hour(spark, sf_dir):
    return _one_measure(spark, sf_dir, "clicks")


@_query
def bid_set_by_hour(spark, sf_dir):
    return _one_measure(spark, sf_dir, "bid_set")


@_query
def spend_by_hour(spark, sf_dir):
    return _one_measure(spark, sf_dir, "spend_hour")


@_query
def conversions_by_hour(spark, sf_dir):
    return _one_measure(spark, sf_dir, "conversion")


@_query
def qualified_by_hour(spark, sf_dir):
    return _one_measure(spark, sf_dir, "qualified_application")


@_query
def disqualified_by_hour(spark, sf_dir):
    return _one_measure(spark, sf_dir, "disqualified_application")


@_query
def kind_flags(spark, sf_dir):
    flags = {f"is_{kind}": is_kind(kind).cast("int") for kind in ("click", "conversion", "qualified", "unqualified")}
    return inputs.tracking(spark, sf_dir).select(
        "create_time", "custom_track", *[flag.alias(name) for name, flag in flags.items()]
    )


@_query
def default_dims_(spark, sf_dir):
    return default_dims(require_job(inputs.tracking(spark, sf_dir))).select("create_time", *ID_COLUMNS)


@_query
def require_job_(spark, sf_dir):
    return require_job(inputs.tracking(spark, sf_dir)).select("create_time", "job_id")


@_query
def event_hour_keys(spark, sf_dir):
    return _shown(with_hour(inputs.tracking(spark, sf_dir)), ["create_time", "dates", "hours"])


@_query
def millis_round_trip(spark, sf_dir):
    counted = inputs.tracking(spark, sf_dir).select("create_time", millis(F.col("ts")).alias("ts_millis"))
    back = saturating_instant(F.col("ts_millis"))
    return counted.select(
        "create_time", "ts_millis", F.unix_micros(back).alias("back_micros"), F.hour(back).alias("back_hour")
    )


# Enrichment and contract


@_query
def rollup_with_company(spark, sf_dir):
    enriched = with_company(hourly(inputs.tracking(spark, sf_dir)), inputs.job(spark, sf_dir))
    return _shown(enriched, [*HOUR_KEYS, "company_id", *MEASURES])


@_query
def events_written(spark, sf_dir):
    rows = hourly_events(inputs.tracking(spark, sf_dir), inputs.job(spark, sf_dir))
    return _shown(rows, EVENTS_WRITTEN)


@_query
def events_contract(spark, sf_dir):
    rows = hourly_events(inputs.tracking(spark, sf_dir), inputs.job(spark, sf_dir))
    return _shown(events_rows(spark, rows), ["id", *EVENTS_WRITTEN, "sources"])


@_query
def stored_job_dimension(spark, sf_dir):
    path = scratch(spark, "job")
    inputs.job(spark, sf_dir).write.parquet(path)
    return stored_dimension(spark, path, JOB)


# References


def _by_job(spark, sf_dir):
    return Reference("job_id", inputs.job(spark, sf_dir), "job_id")


def _by_publisher(spark, sf_dir):
    return Reference("publisher_id", inputs.publisher(spark, sf_dir), "id")


def _facts(spark, sf_dir):
    return hourly(inputs.tracking(spark, sf_dir))


@_query
def reference_ok_job(spark, sf_dir):
    good, _ = split_by_reference(_facts(spark, sf_dir), _by_job(spark, sf_dir))
    return _shown(good, [*HOUR_KEYS, "clicks"])


@_query
def reference_bad_job(spark, sf_dir):
    _, bad = split_by_reference(_facts(spark, sf_dir), _by_job(spark, sf_dir))
    return _shown(bad, [*HOUR_KEYS, "clicks"])


@_query
def reference_ok_publisher(spark, sf_dir):
    good, _ = split_by_reference(_facts(spark, sf_dir), _by_publisher(spark, sf_dir))
    return _shown(good, [*HOUR_KEYS, "clicks"])


@_query
def reference_bad_publisher(spark, sf_dir):
    _, bad = split_by_reference(_facts(spark, sf_dir), _by_publisher(spark, sf_dir))
    return _shown(bad, [*HOUR_KEYS, "clicks"])


@_query
def reference_failures(spark, sf_dir):
    both = [_by_job(spark, sf_dir), _by_publisher(spark, sf_dir)]
    _, bad = split_by_reference(_facts(spark, sf_dir), *both)
    return _shown(bad, [*HOUR_KEYS, "failed_reference"])


@_query
def reference_raw_publisher(spark, sf_dir):
    """On raw rows, where a missing publisher is still NULL and so valid."""
    good, _ = split_by_reference(inputs.tracking(spark, sf_dir), _by_publisher(spark, sf_dir))
    return good.select("create_time", "publisher_id")


@_query
def nullify_deleted_jobs(spark, sf_dir):
    return _shown(nullify_deleted(_facts(spark, sf_dir), _by_job(spark, sf_dir)), [*HOUR_KEYS, "clicks"])


@_query
def nullify_deleted_publishers(spark, sf_dir):
    return _shown(nullify_deleted(_facts(spark, sf_dir), _by_publisher(spark, sf_dir)), [*HOUR_KEYS, "clicks"])


@_query
def remap_job_keys(spark, sf_dir):
    moves = inputs.job(spark, sf_dir).select(
        F.col("job_id").alias("old_key"), (F.col("job_id") + 1000).alias("new_key")
    )
    return _shown(remap_keys(_facts(spark, sf_dir), "job_id", moves), [*HOUR_KEYS, "clicks"])


@_query
def remap_publisher_keys(spark, sf_dir):
    moves = inputs.publisher(spark, sf_dir).select(
        F.col("id").alias("old_key"), (F.col("id") + 1000).alias("new_key")
    )
    return _shown(remap_keys(_facts(spark, sf_dir), "publisher_id", moves), [*HOUR_KEYS, "clicks"])


# Envelopes


@_query
def envelope_build(spark, sf_dir):
    """Messages taken apart again level by level, without the parse schema."""
    kinds = {name: kind for name, kind in TRACKING.items() if name in RAW} | {"ts": "bigint", "bid": "double"}
    payload = F.get_json_object(F.col("value").cast("string"), "$.payload")
    return (
        to_envelope(inputs.tracking(spark, sf_dir))
        .select(F.json_tuple(payload, "after", "op", "ts_ms").alias("after", "op", "ts_ms"))
        .select("*", F.json_tuple("after", *kinds).alias(*kinds))
        .withColumns({name: F.col(name).cast(kind) for name, kind in kinds.items()})
        .select(
            *[F.col("ts").alias("ts_millis") if name == "ts" else _comparable(name) for name in kinds],
            F.size(F.json_object_keys("after")).alias("n_fields"),
            "op",
            F.col("ts_ms").isNotNull().cast("int").alias("has_capture_time"),
        )
    )


@_query
def envelope_parse(spark, sf_dir):
    return _shown(read_changes(to_envelope(inputs.tracking(spark, sf_dir))), RAW)


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven in ten messages lose their job, each in its own way, and one its bid."""
    messages = to_envelope(inputs.tracking(spark, sf_dir)).select(F.col("value").cast("string").alias("text"))
    number = F.get_json_object("text", "$.payload.after.create_time").cast("bigint") % 10
    damaged = (
        F.when(number == 0, F.regexp_replace("text", "[}]+$", ""))
        .when(number == 1, F.lit("{}"))
        .when(number == 2, F.lit(None))
        .when(number == 3, F.lit('{"payload":{"after":null,"op":"c"}}'))
        .when(number == 4, F.regexp_replace("text", '"job_id":[^,]*', '"job_id":"abc"'))
        .when(number == 5, F.regexp_replace("text", '"job_id":[^,]*', '"job_id":2.5'))
        .when(number == 6, F.regexp_replace("text", '"job_id":[^,]*', '"job_id":3000000000'))
        .when(number == 7, F.regexp_replace("text", '"bid":[^,]*', '"bid":"x"'))
        .otherwise(F.col("text"))
    )
    return messages.select(damaged.cast("binary").alias("value"))


@_query
def bad_records_dropped(spark, sf_dir):
    changes = read_changes(_damaged(spark, sf_dir), ["create_time", *ROLLUP_FIELDS])
    return _shown(require_job(changes), ["create_time", "job_id", "custom_track", "bid", "ts"])


@_query
def dead_letters_(spark, sf_dir):
    """Every message is a row that was read or a dead letter with its reason and bytes."""
    folder = scratch(spark, "letters")
    read_or_refuse(_damaged(spark, sf_dir), ["create_time", *ROLLUP_FIELDS]).write.parquet(folder)
    read = spark.read.parquet(folder)
    letters = dead_letters(read).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count("value").alias("n_with_bytes")
    )
    rows = living(read).agg(F.lit("read").alias("reason"), F.count(F.lit(1)).alias("n_messages"))
    return letters.unionByName(rows.withColumn("n_with_bytes", F.lit(0).cast("bigint")))


@_query
def stream_dead_letters(spark, sf_dir):
    """A stream of whole and damaged messages: tallies of what could be read, and a table of the rest."""
    folder = scratch(spark, "dead-stream")
    _damaged(spark, sf_dir).write.parquet(f"{folder}/topic")
    dead = BatchTable(f"{folder}/dead", {"reason": "string", "value": "binary"})
    table = tally_table(f"{folder}/tallies")
    topic = topic_stream(spark, {"path": f"{folder}/topic", "maxFilesPerTrigger": "2"}, "parquet")
    run_to_end(topic, table.write, f"{folder}/checkpoint", dead=dead.write, landing=f"{folder}/landing")
    refused = dead.read(spark).agg(F.lit("dead").alias("kind"), F.count(F.lit(1)).alias("n"))
    counted = table.read(spark).agg(F.lit("counted").alias("kind"), F.sum("n_events").alias("n"))
    return refused.unionByName(counted)


@_query
def publish_and_read_back(spark, sf_dir):
    path = scratch(spark, "topic")
    publish(to_envelope(inputs.tracking(spark, sf_dir)), {"path": path}, "parquet")
    return _shown(read_changes(spark.read.schema("value binary").parquet(path)), RAW)


# Change capture


@_query
def incremental_scan_(spark, sf_dir):
    return _shown(incremental_scan(inputs.tracking(spark, sf_dir), CURSOR), RAW)


@_query
def snapshot_scan(spark, sf_dir):
    rows = incremental_scan(inputs.tracking(spark, sf_dir), EPOCH)
    return _shown(rows.withColumn("op", op_code(EPOCH)), ["create_time", "job_id", "ts", "op"])


@_query
def bounded_scan(spark, sf_dir):
    bounds = {"until": "2024-01-20T12:00:00Z", "settle": "2 hours", "overlap": "6 hours"}
    rows = incremental_scan(inputs.tracking(spark, sf_dir), CURSOR, **bounds)
    return _shown(rows, ["create_time", "ts"])


@_query
def op_code_(spark, sf_dir):
    raw = inputs.tracking(spark, sf_dir)
    messages = to_envelope(incremental_scan(raw, EPOCH), EPOCH).unionByName(
        to_envelope(incremental_scan(raw, CURSOR), CURSOR)
    )
    op = F.get_json_object(F.col("value").cast("string"), "$.payload.op").alias("op")
    return messages.groupBy(op).agg(F.count(F.lit(1)).alias("n_messages"))


@_query
def next_cursor_(spark, sf_dir):
    """Next cursor after a scan with rows and after one without, by either rule."""
    raw = inputs.tracking(spark, sf_dir)
    cases = []
    for scan, cursor in (("rows", CURSOR), ("empty", "2024-01-31T12:00:00Z")):
        for rule in ("safe", "strict"):
            found = next_cursor(incremental_scan(raw, cursor), cursor, POLL_START, strict=rule == "strict")
            cases.append(
                found.select(
                    F.lit(scan).alias("scan"),
                    F.lit(rule).alias("rule"),
                    F.unix_micros("next_cursor").alias("next_micros"),
                    "sent",
                )
            )
    first, *rest = cases
    for case in rest:
        first = first.unionByName(case)
    return first


@_query
def scan_count(spark, sf_dir):
    raw = inputs.tracking(spark, sf_dir)
    return next_cursor(incremental_scan(raw, CURSOR), CURSOR, POLL_START).select("sent")


@_query
def cursor_text_round_trip(spark, sf_dir):
    text = iso_text(F.col("ts"))
    return inputs.tracking(spark, sf_dir).select(
        "create_time", text.alias("cursor_text"), F.unix_micros(parse_iso(text)).alias("cursor_micros")
    )


@_query
def cursor_round_trip(spark, sf_dir):
    """Two polls with a stored cursor and an overlap publish every row; copies drop out."""
    raw = inputs.tracking(spark, sf_dir)
    folder = scratch(spark, "increments")
    cursors, topic = CursorTable(f"{folder}/cursor"), f"{folder}/topic"
    for poll_start in (CURSOR, POLL_START):
        run_increment(
            raw,
            cursors,
            lambda messages: publish(messages, {"path": topic}, "parquet"),
            poll_start=poll_start,
            overlap="6 hours",
        )
    changes = read_changes(spark.read.schema("value binary").parquet(topic))
    return _shown(distinct_changes(changes), RAW)


@_query
def late_rows_captured(spark, sf_dir):
    """One row in ten arrives after the first poll, most with an older ``ts``; each comes out once."""
    raw = inputs.tracking(spark, sf_dir)
    early = raw.where(F.pmod(F.hash("create_time"), F.lit(10)) != 0)
    folder = scratch(spark, "late")
    cursors, topic = CursorTable(f"{folder}/cursor"), f"{folder}/topic"
    for rows in (early, raw):
        run_increment(
            rows,
            cursors,
            lambda messages: publish(messages, {"path": topic}, "parquet"),
            poll_start=POLL_START,
            overlap="400 days",
        )
    changes = read_changes(spark.read.schema("value binary").parquet(topic))
    return _shown(distinct_changes(changes), RAW)


@_query
def late_rows_sent_once(spark, sf_dir):
    """One row in ten arrives 40 minutes late; five polls with the program's defaults send each row once."""
    raw = inputs.tracking(spark, sf_dir)
    late = F.pmod(F.hash("create_time"), F.lit(10)) == 0
    arrival = F.when(late, F.col("ts") + F.expr("INTERVAL 40 MINUTES")).otherwise(F.col("ts"))
    folder = scratch(spark, "ledger")
    cursors, ledger, topic = CursorTable(f"{folder}/cursor"), SentLedger(f"{folder}/ledger"), f"{folder}/topic"
    lease = cursors.take_lease(spark)
    for day in ("06", "12", "18", "24", "31"):
        poll_start = f"2024-01-{day}T12:00:00Z" if day != "31" else POLL_START
        run_increment(
            raw.where(arrival <= F.lit(poll_start).cast("timestamp")),
            cursors,
            lambda messages: publish(messages, {"path": topic}, "parquet"),
            poll_start=poll_start,
            settle="2 seconds",
            overlap="1 hour",
            ledger=ledger,
            lease=lease,
        )
    return _shown(read_changes(spark.read.schema("value binary").parquet(topic)), RAW)


@_query
def op_code_by_span(spark, sf_dir):
    """A first load in spans: every message carries the code of a first load, those after it do not."""
    raw = inputs.tracking(spark, sf_dir)
    folder = scratch(spark, "codes")
    cursors, topic = CursorTable(f"{folder}/cursor"), f"{folder}/topic"
    while True:
        step = run_increment(
            raw,
            cursors,
            lambda messages: publish(messages, {"path": topic}, "parquet"),
            poll_start=POLL_START,
            span="10 days",
        )
        if not step.sent:
            break
    code = F.get_json_object(F.col("value").cast("string"), "$.payload.op").alias("op")
    sent = spark.read.schema("value binary").parquet(topic).groupBy(code)
    return sent.agg(F.count(F.lit(1)).alias("n_messages"))


@_query
def increments_by_span(spark, sf_dir):
    """A first scan in stretches of ten days: what each sent and where the cursor stood."""
    raw = inputs.tracking(spark, sf_dir)
    folder = scratch(spark, "spans")
    cursors = CursorTable(f"{folder}/cursor")
    steps = [
        run_increment(
            raw,
            cursors,
            lambda messages: publish(messages, {"path": f"{folder}/topic"}, "parquet"),
            poll_start=POLL_START,
            span="10 days",
        )
        for _ in range(3)
    ]
    rows = [(n, step.next_cursor, step.sent) for n, step in enumerate(steps)]
    stepped = spark.createDataFrame(rows, "step int, cursor_text string, sent bigint")
    return stepped.select("step", F.unix_micros(parse_iso(F.col("cursor_text"))).alias("cursor_micros"), "sent")


@_query
def stored_cursor(spark, sf_dir):
    """What the cursor table holds after two polls, and what each poll sent."""
    raw = inputs.tracking(spark, sf_dir)
    folder = scratch(spark, "cursor")
    cursors = CursorTable(f"{folder}/cursor")
    sent = [
        run_increment(
            raw,
            cursors,
            lambda messages: publish(messages, {"path": f"{folder}/topic"}, "parquet"),
            poll_start=poll_start,
        ).sent
        for poll_start in (CURSOR, POLL_START)
    ]
    held = parse_iso(F.lit(cursors.load(spark)))
    return spark.range(1).select(
        F.unix_micros(held).alias("cursor_micros"),
        F.lit(sent[0]).cast("bigint").alias("first_sent"),
        F.lit(sent[1]).cast("bigint").alias("second_sent"),
    )


@_query
def deduped_changes(spark, sf_dir):
    raw = inputs.tracking(spark, sf_dir)
    return _shown(distinct_changes(raw.unionByName(raw)), RAW)


@_query
def conflicting_changes_(spark, sf_dir):
    """Every change is sent twice, and one in seven a third time with another bid."""
    raw = inputs.tracking(spark, sf_dir)
    other = raw.where(F.col("create_time").cast("bigint") % 7 == 0).withColumn("bid", F.lit(-1).cast("float"))
    return conflicting_changes(raw.unionByName(raw).unionByName(other))


@_query
def lateness_quantiles_(spark, sf_dir):
    """Sketches of three batches, added up; a row is late by the square of a number its id gives, in milliseconds."""
    raw = inputs.tracking(spark, sf_dir)
    number = F.pmod(F.col("create_time").cast("bigint") * 7919, F.lit(10007))
    arrived = F.timestamp_millis(F.unix_millis("ts") + number * number)
    batch = F.pmod(F.hash("create_time"), F.lit(3))
    sketches = [lateness_sketch(raw.where(batch == n), arrived, F.col("ts")) for n in range(3)]
    found = lateness_quantiles(merge_sketches(*sketches), [0.5, 0.9, 0.99, 0.999])
    return found.select("share", F.round("late_ms", 3).alias("late_ms"))


# Streams


def _topic_files(spark: SparkSession, sf_dir: str, slices: int = 3, copies: int = 1) -> dict[str, str]:
    """All messages as files in slices that cut across hours; options for that many batches."""
    path = scratch(spark, "topic")
    messages = to_envelope(inputs.tracking(spark, sf_dir))
    sliced = messages.withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(slices)))
    for _ in range(copies):
        sliced.write.partitionBy("slice").mode("append").parquet(path)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    return {"path": path, "maxBytesPerTrigger": str(ceil(size / slices))}


@_query
def stream_parse(spark, sf_dir):
    folder = scratch(spark, "parsed")
    topic = topic_stream(spark, _topic_files(spark, sf_dir), "parquet")
    query = (
        read_changes(topic)
        .writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _shown(spark.read.parquet(f"{folder}/rows"), RAW)


@_query
def stream_publish(spark, sf_dir):
    """The raw table as a stream of changes, read back from the topic."""
    folder = scratch(spark, "capture")
    inputs.tracking(spark, sf_dir).write.parquet(f"{folder}/raw")
    raw = spark.readStream.schema(spark.read.parquet(f"{folder}/raw").schema).parquet(f"{folder}/raw")
    query = publish_stream(
        raw, {"path": f"{folder}/topic"}, f"{folder}/checkpoint", format="parquet", availableNow=True
    )
    query.awaitTermination()
    return _shown(read_changes(spark.read.schema("value binary").parquet(f"{folder}/topic")), RAW)


@_query
def stream_deltas_compacted(spark, sf_dir):
    """Several batches with hour keys in common, added up per key."""
    folder = scratch(spark, "deltas")
    table = tally_table(f"{folder}/tallies")
    run_to_end(topic_stream(spark, _topic_files(spark, sf_dir), "parquet"), table.write, f"{folder}/checkpoint")
    return _shown(published(spark, table), HOUR_KEYS + MEASURES)


def _halves(rows: DataFrame, column: str) -> list[DataFrame]:
    odd = F.coalesce(F.pmod(F.hash(column), F.lit(2)) == 1, F.lit(False))
    return [rows.where(odd), rows.where(~odd)]


@_query
def two_streams_one_table(spark, sf_dir):
    """Two streams with checkpoints of their own, each with half of the messages, in one tally table."""
    folder = scratch(spark, "two-streams")
    table = tally_table(f"{folder}/tallies")
    for number, half in enumerate(_halves(inputs.tracking(spark, sf_dir), "create_time")):
        to_envelope(half).write.parquet(f"{folder}/topic-{number}")
        topic = topic_stream(spark, {"path": f"{folder}/topic-{number}", "maxFilesPerTrigger": "1"}, "parquet")
        run_to_end(topic, table.write, f"{folder}/checkpoint-{number}")
    return _shown(published(spark, table), HOUR_KEYS + MEASURES)


@_query
def empty_batches_under_dedup(spark, sf_dir):
    """Batches a deduplicating stream has written: none is empty."""
    folder = scratch(spark, "no-empty")
    table = tally_table(f"{folder}/tallies")
    written = []

    def write(tallies, batch_id):
        written.append(batch_id)
        table.write(tallies, batch_id)

    topic = topic_stream(for_state(spark), _topic_files(spark, sf_dir, copies=2), "parquet")
    run_to_end(topic, write, f"{folder}/checkpoint", dedup_horizon="1 day")
    stored = table.read(spark).select("batch_id").distinct().count()
    if not written or stored != len(written):
        raise RuntimeError(f"{len(written)} batches written, {stored} with rows")
    return _shown(published(spark, table), HOUR_KEYS + MEASURES)


@_query
def stream_replay_idempotent(spark, sf_dir):
    """The first batch fails after its write; the restart repeats it without effect."""
    folder = scratch(spark, "replay")
    table = tally_table(f"{folder}/tallies")
    failed = []

    def fail_once(tallies, batch_id):
        table.write(tallies, batch_id)
        if not failed:
            failed.append(batch_id)
            raise RuntimeError("lost after the write")

    options = _topic_files(spark, sf_dir)
    try:
        run_to_end(topic_stream(spark, options, "parquet"), fail_once, f"{folder}/checkpoint")
    except StreamingQueryException:
        pass
    if not failed:
        raise RuntimeError("the first batch did not fail")
    run_to_end(topic_stream(spark, options, "parquet"), fail_once, f"{folder}/checkpoint")
    return _shown(published(spark, table), HOUR_KEYS + MEASURES)


@_query
def stream_deduped(spark, sf_dir):
    """Every message is delivered twice, the copies in batches of their own."""
    folder = scratch(spark, "redelivered")
    table = tally_table(f"{folder}/tallies")
    topic = topic_stream(for_state(spark), _topic_files(spark, sf_dir, copies=2), "parquet")
    run_to_end(topic, table.write, f"{folder}/checkpoint", dedup_horizon="1 day")
    return _shown(published(spark, table), HOUR_KEYS + MEASURES)


@_query
def compacted_table(spark, sf_dir):
    """A partitioned table rebuilt twice, the second time for the last batch's dates."""
    folder = scratch(spark, "compact")
    table = tally_table(f"{folder}/tallies")
    run_to_end(topic_stream(spark, _topic_files(spark, sf_dir), "parquet"), table.write, f"{folder}/checkpoint")
    compact(spark, table, f"{folder}/events")
    compact(spark, table, f"{folder}/events", since_batch=1)
    return _shown(spark.read.parquet(f"{folder}/events"), HOUR_KEYS + MEASURES)


@_query
def compacted_two_streams(spark, sf_dir):
    """Two streams into one tally table, compacted on the way, once stopped before the switch; merged on read."""
    folder = scratch(spark, "compacted-streams")
    table, dated = tally_table(f"{folder}/tallies"), dated_tallies(f"{folder}/compacted")
    halves = _halves(inputs.tracking(spark, sf_dir), "create_time")
    for number, half in enumerate(halves):
        for part, rows in enumerate(_halves(half, "uid")):
            to_envelope(rows).write.mode("append").parquet(f"{folder}/topic-{number}")
            topic = topic_stream(spark, {"path": f"{folder}/topic-{number}", "maxFilesPerTrigger": "1"}, "parquet")
            run_to_end(topic, table.write, f"{folder}/checkpoint-{number}")
            if (number, part) == (0, 0):
                compact_batches(spark, table, dated)
            if (number, part) == (1, 0):
                try:
                    compact_batches(spark, table, dated, before_switch=_stop)
                except _Stopped:
                    pass
                compact_batches(spark, table, dated)
                if not expire_batches(spark, table, dated):
                    raise RuntimeError("no batch was old enough to remove")
    return _shown(served(spark, table, dated), HOUR_KEYS + MEASURES)


class _Stopped(RuntimeError):
    pass


def _stop() -> None:
    raise _Stopped


def _stream_events(spark, sf_dir):
    folder = scratch(spark, "events")
    good = BatchTable(f"{folder}/good", FACT)
    bad = BatchTable(f"{folder}/bad", {**FACT, "failed_reference": "string"})
    sink = deliver(
        lambda: inputs.job(spark, sf_dir),
        good.write,
        lambda: inputs.publisher(spark, sf_dir),
        lambda rows, batch_id: bad.write(rows.withColumn("updated_at", F.current_timestamp()), batch_id),
        f"{folder}/landing",
        check_size=True,
    )
    run_to_end(topic_stream(spark, _topic_files(spark, sf_dir), "parquet"), sink, f"{folder}/checkpoint")
    return good.read(spark), bad.read(spark)


def _added_up(deltas: DataFrame, *others: str) -> DataFrame:
    counters = [name for name in MEASURES if name != "bid_set"]
    added = deltas.groupBy(*HOUR_KEYS, *others).agg(*[F.sum(name).alias(name) for name in counters])
    return _shown(added, [*HOUR_KEYS, *others, *counters])


@_query
def stream_events_appended(spark, sf_dir):
    good, _ = _stream_events(spark, sf_dir)
    return _added_up(good, "company_id")


@_query
def stream_events_quarantined(spark, sf_dir):
    _, bad = _stream_events(spark, sf_dir)
    return _added_up(bad, "failed_reference")


@_query
def readmitted_after_growth(spark, sf_dir):
    """The publisher table grows while a stream runs; refused rows come back, each once, though a pass is stopped."""
    folder = scratch(spark, "readmitted")
    good = BatchTable(f"{folder}/good", FACT)
    bad = BatchTable(f"{folder}/bad", {**FACT, "failed_reference": "string"})
    whole = inputs.publisher(spark, sf_dir)
    known = [whole.where("false")]
    sink = deliver(
        lambda: inputs.job(spark, sf_dir),
        good.write,
        lambda: known[-1],
        lambda rows, batch_id: bad.write(rows.withColumn("updated_at", F.current_timestamp()), batch_id),
        f"{folder}/landing",
    )

    def grow_after(tallies, batch_id):
        sink(tallies, batch_id)
        known.append(whole)

    run_to_end(topic_stream(spark, _topic_files(spark, sf_dir), "parquet"), grow_after, f"{folder}/checkpoint")
    references = [
        Reference("job_id", inputs.job(spark, sf_dir), "job_id", carry=("company_id",)),
        Reference("publisher_id", whole, "id"),
    ]
    try:
        readmit(spark, bad, f"{folder}/refused", good, references, before_switch=_stop)
    except _Stopped:
        pass
    readmit(spark, bad, f"{folder}/refused", good, references)
    readmit(spark, bad, f"{folder}/refused", good, references)
    kept = _added_up(good.read(spark), "company_id").withColumn("failed_reference", F.lit(None).cast("string"))
    left = _added_up(still_refused(spark, bad, f"{folder}/refused"), "company_id", "failed_reference")
    return kept.unionByName(left)


# The stored fact


def _stored_facts(spark, sf_dir, rows):
    table = DatedTable(scratch(spark, "fact"), {name: EVENTS[name] for name in EVENTS_WRITTEN})
    table.append(to_events_contract(rows))
    return table


@_query
def stored_nullify_jobs(spark, sf_dir):
    """Jobs are gone from the dimension; the dates that hold them are copied, and a second run changes nothing."""
    facts = with_company(_facts(spark, sf_dir), inputs.job(spark, sf_dir))
    table = _stored_facts(spark, sf_dir, facts)
    first = nullify_stored(spark, table, _by_job(spark, sf_dir))
    if nullify_stored(spark, table, _by_job(spark, sf_dir)) != first:
        raise RuntimeError("a repeated run has changed the table")
    return _shown(table.read(spark), EVENTS_WRITTEN)


@_query
def stored_remap_publishers(spark, sf_dir):
    """Keys move on by one in the stored fact, so that old and new ones overlap; a repeated change is not made twice."""
    table = _stored_facts(spark, sf_dir, with_company(_facts(spark, sf_dir), inputs.job(spark, sf_dir)))
    moves = spark.createDataFrame([(1, 2), (2, 3)], "old_key int, new_key int")
    for _ in range(2):
        remap_stored(spark, table, "publisher_id", moves, "renumbered")
    return _shown(table.read(spark), EVENTS_WRITTEN)


@_query
def company_backfilled(spark, sf_dir):
    """Half of the jobs arrive after their facts were stored; those rows then get their company."""
    job = inputs.job(spark, sf_dir)
    table = _stored_facts(spark, sf_dir, with_company(_facts(spark, sf_dir), job.where("job_id % 2 = 0")))
    table.expire(spark)
    backfill_company(spark, table, job.where("job_id % 2 = 1"))
    return _shown(table.read(spark), EVENTS_WRITTEN)


@_query
def company_as_of(spark, sf_dir):
    """Jobs of even number change hands in the middle of the table's time."""
    job = inputs.job(spark, sf_dir).select("job_id", "company_id", F.lit(None).cast("timestamp").alias("valid_from"))
    moved = job.where("job_id % 2 = 0").select(
        "job_id", (F.col("company_id") + 100).alias("company_id"), F.lit("2024-01-15T12:00:00Z").cast("timestamp").alias("valid_from")
    )
    return _shown(with_company_as_of(_facts(spark, sf_dir), job.unionByName(moved)), [*HOUR_KEYS, "company_id", "clicks"])


# Tables


@_query
def table_append_with_defaults(spark, sf_dir):
    """Fact rows into a catalog table whose source column is left to its default."""
    path = scratch(spark, "table")
    table = create_table(
        spark,
        f"events_{uuid.uuid4().hex}",
        {name: EVENTS[name] for name in [*EVENTS_WRITTEN, "sources", "updated_at"]},
        path,
        {"sources": "'Cassandra'", "updated_at": "current_timestamp()"},
        "dates",
    )
    rows = hourly_events(inputs.tracking(spark, sf_dir), inputs.job(spark, sf_dir)).drop("updated_at")
    table_append(rows, table)
    stored = spark.table(table).where(F.col("updated_at").isNotNull())
    return _shown(stored, [*EVENTS_WRITTEN, "sources"])


@_query
def append_after_partial_failure(spark, sf_dir):
    """Part of a batch is stored when the append fails; its replay adds only the rest."""
    path = scratch(spark, "append")
    rows = hourly_events(inputs.tracking(spark, sf_dir), inputs.job(spark, sf_dir))

    def stored(stream_id, batch_id):
        return spark.read.parquet(path).where((F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id))

    rows.where(F.col("dates") < F.lit("2024-01-10").cast("date")).withColumns(
        {"stream_id": F.lit("one"), "batch_id": F.lit(7).cast("bigint")}
    ).write.parquet(path)
    append_once(rows, 7, stored, lambda chosen: chosen.write.mode("append").parquet(path), "one")
    return _shown(spark.read.parquet(path), EVENTS_WRITTEN)


@_query
def append_once_two_streams(spark, sf_dir):
    """Two streams append the same batch id, each twice; every row is stored once."""
    path = scratch(spark, "append")
    halves = _halves(hourly_events(inputs.tracking(spark, sf_dir), inputs.job(spark, sf_dir)), "job_id")

    def stored(stream_id, batch_id):
        return spark.read.parquet(path).where((F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id))

    empty = halves[0].limit(0).withColumns({"stream_id": F.lit(""), "batch_id": F.lit(0).cast("bigint")})
    empty.write.parquet(path)
    for stream_id, half in zip(("one", "two", "one", "two"), halves * 2):
        append_once(half, 0, stored, lambda chosen: chosen.write.mode("append").parquet(path), stream_id)
    return _shown(spark.read.parquet(path), EVENTS_WRITTEN)


@_query
def events_contract_appended(spark, sf_dir):
    """Two appends with ids that go on from the stored ones."""
    path = scratch(spark, "facts")
    contract = to_events_contract(
        with_company(hourly(inputs.tracking(spark, sf_dir)), inputs.job(spark, sf_dir))
    )
    start = 0
    for half in _halves(contract, "job_id"):
        events_rows(spark, half, start).write.mode("append").parquet(path)
        start = last_id(spark.read.parquet(path))
    stored = spark.read.parquet(path)
    ids = stored.agg(F.min("id").alias("first"), F.max("id").alias("last"), F.countDistinct("id").alias("n")).first()
    if (ids["first"], ids["last"]) != (1, ids["n"]):
        raise RuntimeError(f"ids are not dense: {ids}")
    return _shown(stored, [*EVENTS_WRITTEN, "sources"])


@_query
def ids_reserved(spark, sf_dir):
    """Two appends take their ids from reserved ranges; the stored fact is not read for them."""
    path, ranges = scratch(spark, "facts"), IdRanges(scratch(spark, "ids"))
    for half in _halves(hourly_events(inputs.tracking(spark, sf_dir), inputs.job(spark, sf_dir)), "job_id"):
        events_rows(spark, half, lambda n: ranges.reserve(spark, n)).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    if stored.groupBy("id").count().where("count > 1").limit(1).count():
        raise RuntimeError("an id was given twice")
    return _shown(stored, [*EVENTS_WRITTEN, "sources"])


@_query
def stored_tables(spark, sf_dir):
    """Columns of the created tables and how many rows fill each."""
    tables = create_all(spark, scratch(spark, "tables"), f"t{uuid.uuid4().hex}_")
    raw, job, publisher = (read(spark, sf_dir) for read in (inputs.tracking, inputs.job, inputs.publisher))
    table_append(raw, tables["tracking"])
    table_append(job, tables["job"])
    table_append(publisher, tables["master_publisher"])
    table_append(events_rows(spark, to_events_contract(with_company(hourly(raw), job))), tables["events"])
    described = []
    for name, columns in DEFINITIONS.items():
        table = spark.table(tables[name])
        kinds = {field.name: field.dataType.simpleString() for field in table.schema}
        filled = table.agg(*[F.count(column).alias(column) for column in columns])
        per_column = filled.unpivot([], list(columns), "column_name", "filled")
        kind_of = F.create_map(*[F.lit(part) for item in kinds.items() for part in item])
        kind = kind_of[F.col("column_name")].alias("column_type")
        described.append(per_column.select(F.lit(name).alias("table_name"), "column_name", kind, "filled"))
    first, *rest = described
    for frame in rest:
        first = first.unionByName(frame)
    return first
