from __future__ import annotations

import pytest
from support import event, rows_of
from pyspark.errors import StreamingQueryException

from tallyhour.jobs import bootstrap as bootstrap_job
from tallyhour.jobs import capture as capture_job
from tallyhour.jobs import compact as compact_job
from tallyhour.jobs import rollup as rollup_job
from tallyhour.jobs.options import option_map
from tallyhour.operators.envelope import read_changes, to_envelope
from tallyhour.operators.rollup import hourly
from tallyhour.plans.batch import deliver
from tallyhour.schemas import EVENTS, EVENTS_WRITTEN, JOB, ddl
from tallyhour.session import scratch
from tallyhour.sinks.batches import BatchTable, published, tally_table
from tallyhour.sinks.ids import IdRanges
from tallyhour.sources.dimension import stored_dimension
from tallyhour.sources.topic import topic_stream
from tallyhour.streaming.capture import POLL_TRIGGER, publish_stream
from tallyhour.streaming.rollup import run_rollup, run_to_end

FACT = {name: EVENTS[name] for name in [*EVENTS_WRITTEN, "updated_at"]}
SHOWN = ["job_id", "dates", "hours", "clicks", "bid_set", "spend_hour"]


class Pipeline:
    def __init__(self, spark, files_per_batch=1):
        self.spark = spark
        self.folder = scratch(spark, "stream")
        self.options = {"path": f"{self.folder}/topic", "maxFilesPerTrigger": str(files_per_batch)}
        self.tallies = tally_table(f"{self.folder}/tallies")

    def send(self, raw):
        to_envelope(raw).coalesce(1).write.mode("append").parquet(self.options["path"])

    def topic(self):
        return topic_stream(self.spark, self.options, "parquet")

    def run(self, sink=None):
        query = run_to_end(self.topic(), sink or self.tallies.write, f"{self.folder}/checkpoint")
        return [batch["batchId"] for batch in query.recentProgress if batch["numInputRows"]]


@pytest.fixture
def pipeline(spark):
    return Pipeline(spark)


def test_batches_add_up_to_one_rollup(spark, pipeline, tracking):
    parts = [tracking(event(bid=1.0), event(kind="view")), tracking(event(bid=4.0)), tracking(event(bid=None))]
    for part in parts:
        pipeline.send(part)
    assert pipeline.run() == [0, 1, 2]
    assert pipeline.tallies.read(spark).count() == 3
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert rows_of(published(spark, pipeline.tallies), *SHOWN) == rows_of(hourly(whole), *SHOWN)


def test_restart_reads_only_what_is_new(spark, pipeline, tracking):
    pipeline.send(tracking(event()))
    assert pipeline.run() == [0]
    assert pipeline.run() == []
    pipeline.send(tracking(event()))
    assert pipeline.run() == [1]
    assert rows_of(published(spark, pipeline.tallies), "clicks") == [(2,)]


@pytest.mark.parametrize("after_write", [False, True])
def test_a_failed_batch_is_repeated_not_lost(spark, pipeline, tracking, after_write):
    for job in (1, 2, 3):
        pipeline.send(tracking(event(job=job)))
    failures = []

    def fragile(tallies, batch_id):
        if batch_id == 1 and not failures:
            if after_write:
                pipeline.tallies.write(tallies, batch_id)
            failures.append(batch_id)
            raise OSError("target is down")
        pipeline.tallies.write(tallies, batch_id)

    with pytest.raises(StreamingQueryException):
        pipeline.run(fragile)
    assert pipeline.run(fragile) == [1, 2]
    assert rows_of(published(spark, pipeline.tallies), "job_id", "clicks") == [(1, 1), (2, 1), (3, 1)]


def test_late_events_are_never_dropped(spark, pipeline, tracking):
    for ts in ("2025-10-01T10:00:00", "2031-01-01T00:00:00", "1999-01-01T00:00:00", "2025-10-01T10:30:00"):
        pipeline.send(tracking(event(ts=ts)))
    pipeline.run()
    assert rows_of(published(spark, pipeline.tallies).selectExpr("year(dates) AS y", "clicks"), "y", "clicks") == [
        (1999, 1),
        (2025, 2),
        (2031, 1),
    ]


def test_an_empty_batch_writes_nothing(spark, pipeline, tracking):
    pipeline.send(tracking(event()).where("false"))
    pipeline.send(tracking(event()))
    pipeline.run()
    assert [row.batch_id for row in pipeline.tallies.read(spark).collect()] in ([0], [1])


def test_a_batch_of_garbage_stops_nothing(spark, pipeline, messages, tracking):
    messages("nope", None, "{}").coalesce(1).write.mode("append").parquet(pipeline.options["path"])
    pipeline.send(tracking(event()))
    assert len(pipeline.run()) == 2
    assert rows_of(published(spark, pipeline.tallies), "clicks") == [(1,)]


def test_dimension_is_read_anew_and_rows_are_not_filled_later(spark, pipeline, tracking):
    path = f"{pipeline.folder}/job"
    spark.createDataFrame([(2, 20, 0, 0)], ddl(JOB)).write.parquet(path)
    fact = BatchTable(f"{pipeline.folder}/events", FACT)
    sink = deliver(lambda: stored_dimension(spark, path), fact.write, check_size=True)
    pipeline.send(tracking(event(job=1)))
    pipeline.run(sink)
    spark.createDataFrame([(1, 10, 0, 0)], ddl(JOB)).write.mode("append").parquet(path)
    pipeline.send(tracking(event(job=1)))
    pipeline.run(sink)
    assert rows_of(fact.read(spark), "batch_id", "job_id", "company_id", "clicks") == [(0, 1, None, 1), (1, 1, 10, 1)]


def test_a_batch_leaves_few_files_at_any_shuffle_width(spark, pipeline, tracking, conf):
    conf(spark__sql__shuffle__partitions="64")
    pipeline.send(tracking(*[event(job=n) for n in range(200)]))
    fact = BatchTable(f"{pipeline.folder}/events", FACT)
    refused = BatchTable(f"{pipeline.folder}/refused", {**FACT, "failed_reference": "string"})
    jobs = spark.range(100).selectExpr("CAST(id AS int) AS job_id", "1 AS company_id")

    def sink(tallies, batch_id):
        pipeline.tallies.write(tallies, batch_id)
        stamped = lambda rows, n: refused.write(rows.selectExpr("*", "current_timestamp() AS updated_at"), n)
        deliver(lambda: jobs, fact.write, quarantine=stamped, landing=f"{pipeline.folder}/landing")(tallies, batch_id)

    pipeline.run(sink)
    for table, n_rows in ((pipeline.tallies, 200), (fact, 100), (refused, 100)):
        rows = table.read(spark)
        assert rows.count() == n_rows
        assert len(rows.inputFiles()) <= 4


def test_quarantine_needs_a_landing_folder():
    with pytest.raises(ValueError):
        deliver(lambda: None, lambda rows, n: None, quarantine=lambda rows, n: None)


def test_live_trigger_and_wait(spark, pipeline, tracking):
    pipeline.send(tracking(event()))
    query = run_rollup(pipeline.topic(), pipeline.tallies.write, f"{pipeline.folder}/checkpoint", processingTime="100 milliseconds")
    try:
        assert query.awaitTermination(1) is False
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows_of(published(spark, pipeline.tallies), "clicks") == [(1,)]


def test_raw_table_as_a_stream_of_changes(spark, tracking):
    folder = scratch(spark, "capture")
    raw = tracking(event(), event(ts=None), event(job=None))
    raw.write.parquet(f"{folder}/raw")
    stream = spark.readStream.schema(raw.schema).parquet(f"{folder}/raw")
    query = publish_stream(stream, {"path": f"{folder}/topic"}, f"{folder}/cp", "parquet", availableNow=True)
    query.awaitTermination()
    sent = read_changes(spark.read.schema("value binary").parquet(f"{folder}/topic"))
    assert rows_of(sent, "create_time", "job_id") == [("t0", 1), ("t2", None)]
    assert POLL_TRIGGER == {"processingTime": "500 milliseconds"}


def test_kafka_defaults_to_the_earliest_offset(monkeypatch):
    class Reader:
        def __init__(self):
            self.seen = {}

        def format(self, name):
            self.seen["format"] = name
            return self

        def option(self, key, value):
            self.seen[key] = value
            return self

        def options(self, **options):
            self.seen.update(options)
            return self

        def load(self):
            return self

        def select(self, *names):
            self.seen["select"] = names
            return self

    class Session:
        readStream = Reader()

    seen = topic_stream(Session, {"kafka.bootstrap.servers": "b:1", "subscribe": "t"}).seen
    assert seen == {
        "format": "kafka", "startingOffsets": "earliest", "kafka.bootstrap.servers": "b:1", "subscribe": "t", "select": ("value",),
    }


@pytest.mark.parametrize("dedup", [[], ["--dedup-horizon", "1 hour"]])
def test_programs_from_raw_table_to_fact(spark, tracking, dedup):
    folder = scratch(spark, "jobs")
    tracking(event(), event(job=9), event(publisher=None), event(job=2, kind="qualified")).write.parquet(f"{folder}/raw")
    spark.createDataFrame([(1, 10, 0, 0), (2, 20, 0, 0)], ddl(JOB)).write.parquet(f"{folder}/job")
    spark.createDataFrame([(15,)], "id int").write.parquet(f"{folder}/publisher")
    sent = capture_job.main(
        ["--raw-format", "parquet", "--raw-option", f"path={folder}/raw", "--topic-format", "parquet",
         "--topic-option", f"path={folder}/topic", "--cursor", f"{folder}/cursor", "--polls", "2", "--seconds", "0",
         "--strict"]
    )
    assert sent == 4
    rollup_job.main(
        ["--topic-format", "parquet", "--topic-option", f"path={folder}/topic", "--checkpoint", f"{folder}/cp",
         "--job-path", f"{folder}/job", "--publisher-path", f"{folder}/publisher", "--events-path", f"{folder}/events",
         "--quarantine-path", f"{folder}/bad", "--once", *dedup]
    )
    good = BatchTable(f"{folder}/events", FACT).read(spark)
    bad = BatchTable(f"{folder}/bad", {**FACT, "failed_reference": "string"}).read(spark)
    assert rows_of(good, "job_id", "company_id", "clicks", "qualified_application") == [(1, 10, 1, 0), (2, 20, 0, 1)]
    assert rows_of(bad, "job_id", "publisher_id", "failed_reference") == [(1, 0, "publisher_id"), (9, 15, "job_id")]


def test_capture_as_a_stream(spark, tracking):
    folder = scratch(spark, "raw-stream")
    arguments = ["--raw-format", "parquet", "--raw-option", f"path={folder}/raw", "--topic-format", "parquet",
                 "--topic-option", f"path={folder}/topic", "--stream-checkpoint", f"{folder}/checkpoint", "--once"]
    sent = []
    for rows in ([event(), event(job=2), event(ts=None)], [event(job=3)]):
        tracking(*rows).write.mode("append").parquet(f"{folder}/raw")
        sent.append(capture_job.main(arguments))
    assert sent == [3, 1]
    changes = read_changes(spark.read.schema("value binary").parquet(f"{folder}/topic"))
    assert rows_of(changes, "job_id") == [(1,), (2,), (3,)]


def test_programs_to_a_served_table(spark, tracking):
    """Tallies and dead letters by the rollup, merged and served by the compaction; state can be added to."""
    folder = scratch(spark, "served")
    spark.createDataFrame([(1, 10, 0, 0), (2, 20, 0, 0)], ddl(JOB)).write.parquet(f"{folder}/job")

    def roll(*rows, broken=0):
        messages = to_envelope(tracking(*rows)).unionByName(spark.range(broken).selectExpr("binary('{') as value"))
        messages.write.mode("append").parquet(f"{folder}/topic")
        rollup_job.main(
            ["--topic-format", "parquet", "--topic-option", f"path={folder}/topic", "--checkpoint", f"{folder}/cp",
             "--tally-path", f"{folder}/tallies", "--dead-letter-path", f"{folder}/dead", "--no-dedup", "--once"]
        )
        compact_job.main(
            ["--tally-path", f"{folder}/tallies", "--table-path", f"{folder}/table", "--expire", "--job-path", f"{folder}/job",
             "--serve-path", f"{folder}/served", "--runs", "1"]
        )
        return rows_of(spark.read.parquet(f"{folder}/served"), "job_id", "company_id", "clicks", "bid_set")

    assert roll(event(bid=1.0), event(job=9), broken=2) == sorted([(1, 10, 1, 1.0), (9, None, 1, 1.0)], key=repr)
    assert roll(event(bid=4.0), event(job=2)) == sorted([(1, 10, 2, 2.5), (2, 20, 1, 1.0), (9, None, 1, 1.0)], key=repr)
    assert roll(event(bid=4.0)) == sorted([(1, 10, 3, 3.0), (2, 20, 1, 1.0), (9, None, 1, 1.0)], key=repr)
    dead = BatchTable(f"{folder}/dead", {"reason": "string", "value": "binary"}).read(spark)
    assert rows_of(dead, "reason", "batch_id") == [("not a message", 0)] * 2


def test_bootstrap(spark):
    folder = scratch(spark, "bootstrap")
    tables = bootstrap_job.main(["--folder", folder, "--prefix", "boot_", "--ids-path", f"{folder}/ids", "--last-id", "41"])
    try:
        assert {"stream_id", "batch_id", "sources"} <= set(spark.table(tables["events"]).columns)
        assert IdRanges(f"{folder}/ids").reserve(spark, 5) == 41
    finally:
        for name in tables.values():
            spark.sql(f"DROP TABLE {name}")


def test_options_from_the_environment(monkeypatch):
    monkeypatch.setenv("TARGET_PASSWORD", "secret=1")
    assert option_map(["url=jdbc:x?a=b", "password=env:TARGET_PASSWORD"]) == {"url": "jdbc:x?a=b", "password": "secret=1"}
    with pytest.raises(ValueError):
        option_map(["url"])
