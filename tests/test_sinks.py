from __future__ import annotations

import uuid

import pytest
from support import event, rows_of
from pyspark.sql import functions as F

from tallyhour.operators.contract import events_rows, to_events_contract, with_ids, with_table_defaults
from tallyhour.operators.enrich import with_company
from tallyhour.operators.rollup import hourly, tally
from tallyhour.schemas import EVENTS, EVENTS_WRITTEN, HOUR_KEYS, JOB, PUBLISHER, ddl
from tallyhour.session import scratch
from tallyhour.sinks import jdbc
from tallyhour.sinks.batches import BatchTable, compact, published, tally_table
from tallyhour.sinks.tables import create_all, table_append
from tallyhour.sinks.versions import names
from tallyhour.sources.dimension import JOB_QUERY, jdbc_dimension, jdbc_options, jdbc_table, refreshed, stored_dimension
from tallyhour.sources.raw import raw_table


@pytest.fixture
def contract(spark, tracking):
    def make(*events):
        job = spark.createDataFrame([(1, 10, 0, 0)], ddl(JOB))
        return to_events_contract(with_company(hourly(tracking(*events)), job))

    return make


def test_written_columns_in_order(contract):
    rows = contract(event())
    assert rows.columns == [*EVENTS_WRITTEN, "updated_at"]
    assert dict(rows.dtypes) == {name: kind for name, kind in EVENTS.items() if name in rows.columns}


def test_defaults_fill_only_what_is_missing(contract):
    rows = with_table_defaults(contract(event()).withColumn("sources", F.lit("Log File")))
    assert rows_of(rows, "sources") == [("Log File",)]
    filled = with_table_defaults(contract(event()).drop("updated_at"))
    assert rows_of(filled.withColumn("stamped", F.col("updated_at").isNotNull()), "sources", "stamped") == [("Cassandra", True)]


def test_ids_are_dense_and_ordered_when_one_key_leads(spark):
    rows = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("x")
    )
    numbered = with_ids(rows, ["k", "x"], start=100).collect()
    assert sorted(row.id for row in numbered) == list(range(101, 5101))
    assert [(row.k, row.x) for row in sorted(numbered, key=lambda r: r.id)] == sorted((r.k, r.x) for r in numbered)


def test_ids_of_nothing(spark):
    assert with_ids(spark.range(0).withColumnRenamed("id", "k"), ["k"]).count() == 0


def test_events_rows_have_all_columns(spark, contract):
    rows = events_rows(spark, contract(event(), event(job=2)))
    assert {name: kind for name, kind in rows.dtypes} == EVENTS
    assert rows_of(rows, "id", "job_id", "company_id", "sources") == [(1, 1, 10, "Cassandra"), (2, 2, None, "Cassandra")]


def test_a_repeated_batch_replaces_its_rows(spark, tracking):
    table = tally_table(scratch(spark, "tallies"))
    assert published(spark, table).count() == 0
    table.write(tally(tracking(event(), event(ts="2025-10-02T00:00:00"))), 0)
    table.write(tally(tracking(event())), 1)
    table.write(tally(tracking(event())), 1)
    assert rows_of(published(spark, table), "hours", "clicks") == [(0, 1), (10, 2)]
    table.write(tally(tracking(event())), 0)
    assert rows_of(published(spark, table), "hours", "clicks") == [(10, 2)]


def test_replacing_a_batch_ignores_the_session_overwrite_mode(spark, tracking, conf):
    conf(spark__sql__sources__partitionOverwriteMode="dynamic")
    table = tally_table(scratch(spark, "tallies"))
    table.write(tally(tracking(event())), 0)
    table.write(tally(tracking(event(ts="2025-10-02T00:00:00"))), 0)
    assert rows_of(published(spark, table), "hours", "clicks") == [(0, 1)]


def test_compaction_rebuilds_touched_dates_only(spark, tracking):
    folder = scratch(spark, "compact")
    table, events = tally_table(f"{folder}/tallies"), f"{folder}/events"
    table.write(tally(tracking(event(bid=1.0), event(bid=1.0), event(ts=None), event(ts="2025-10-03T00:00:00"))), 0)
    compact(spark, table, events)
    untouched = spark.read.parquet(f"{events}/dates=2025-10-03").inputFiles()
    table.write(tally(tracking(event(bid=4.0), event(ts=None, bid=None))), 1)
    for _ in range(2):
        compact(spark, table, events, since_batch=1)
        stored = spark.read.parquet(events).withColumn("dates", F.col("dates").cast("string"))
        assert rows_of(stored, "dates", "hours", "clicks", "bid_set") == sorted(
            [("2025-10-01", 10, 3, 2.0), ("2025-10-03", 0, 1, 1.0), (None, None, 2, 1.0)], key=repr
        )
    assert spark.read.parquet(f"{events}/dates=2025-10-03").inputFiles() == untouched


def test_compaction_of_dates_beyond_python(spark, tracking):
    folder = scratch(spark, "compact")
    table = tally_table(f"{folder}/tallies")
    far = tally(tracking(event())).withColumn("dates", F.lit("+294247-01-10").cast("date"))
    table.write(far, 0)
    compact(spark, table, f"{folder}/events")
    assert published(spark, table).selectExpr("year(dates)").first()[0] == 294247
    stored = spark.read.schema(ddl({"clicks": "bigint", "dates": "date"})).parquet(f"{folder}/events")
    assert stored.selectExpr("year(dates)").first()[0] == 294247


def test_append_once_adds_what_is_missing(spark, contract):
    path = scratch(spark, "append")
    rows = contract(event(), event(job=2), event(ts=None))
    appended = []

    def stored(stream_id, batch_id):
        if not appended:
            return rows.where("false").withColumn("batch_id", F.lit(0)).select(*HOUR_KEYS, "batch_id")
        return spark.read.parquet(path).where((F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id))

    def append(chosen):
        appended.append(chosen.count())
        chosen.write.mode("append").parquet(path)

    jdbc.append_once(rows.where("job_id = 1"), 5, stored, append)
    jdbc.append_once(rows, 5, stored, append)
    jdbc.append_once(rows, 5, stored, append)
    jdbc.append_once(rows, 6, stored, append)
    assert appended == [2, 1, 0, 3]
    jdbc.append_once(rows, 6, stored, append, "another")
    assert appended.pop() == 3
    assert spark.read.parquet(path).groupBy("batch_id").count().orderBy("batch_id").collect() == [(5, 3), (6, 6)]


def test_stored_text_dates_match_typed_ones(spark, contract):
    rows = contract(event(), event(ts=None))
    stored = rows.select(*HOUR_KEYS).withColumn("dates", F.col("dates").cast("string"))
    assert jdbc.missing_rows(rows, stored).count() == 0


class Recorder:
    """Stands in for a session or writer; no database is started for tests."""

    def __init__(self):
        self.calls = {}
        self.read = self

    def format(self, name):
        self.calls["format"] = name
        return self

    def options(self, **options):
        self.calls.update(options)
        return self

    def option(self, key, value):
        self.calls[key] = value
        return self

    def mode(self, mode):
        self.calls["mode"] = mode
        return self

    def load(self):
        return self

    def save(self):
        return None

    def select(self, *names):
        self.calls["select"] = names
        return self


CONNECTION = {"url": "jdbc:x:y", "driver": "D", "user": "u", "password": "p"}


def test_jdbc_dimension_options():
    session = Recorder()
    jdbc_dimension(session, CONNECTION)
    assert session.calls == {"format": "jdbc", "query": "SELECT job_id, company_id, group_id, campaign_id FROM job", **CONNECTION}
    assert jdbc_options(CONNECTION)["query"] == JOB_QUERY
    with pytest.raises(ValueError):
        jdbc_options({**CONNECTION, "dbtable": "job"})


def test_jdbc_table_splits_on_its_key():
    session = Recorder()
    jdbc_table(session, CONNECTION, "job", "job_id", (1, 1000), 16)
    assert session.calls["partitionColumn"] == "job_id"
    assert (session.calls["lowerBound"], session.calls["upperBound"], session.calls["numPartitions"]) == (1, 1000, 16)


def test_jdbc_append_options():
    class Rows:
        write = Recorder()
        dealt: list = []

        @classmethod
        def repartition(cls, n):
            cls.dealt.append(n)
            return cls

    jdbc.jdbc_append(Rows, CONNECTION, connections=4)
    assert Rows.write.calls == {"format": "jdbc", "dbtable": "events", "numPartitions": 4, "mode": "append", **CONNECTION}
    assert Rows.dealt == [4]


def test_jdbc_sinks(monkeypatch, contract):
    rows, sent = contract(event(), event(ts=None)), []
    monkeypatch.setattr(jdbc, "jdbc_append", lambda chosen, *rest: sent.append((chosen, rest)))
    monkeypatch.setattr(jdbc, "jdbc_batch_keys", lambda *_: rows.where("hours = 10").select(*HOUR_KEYS))
    jdbc.jdbc_sink(CONNECTION, "facts", 2)(rows, 4)
    jdbc.jdbc_plain_sink(CONNECTION, dates_as_text=True)(rows, 4)
    (once, once_to), (plain, plain_to) = sent
    assert rows_of(once, "dates", "clicks", "batch_id") == [(None, 1, 4)]
    assert once_to == (CONNECTION, "facts", 2)
    assert plain.columns == [*EVENTS_WRITTEN, "updated_at"]
    assert rows_of(plain, "dates") == [("2025-10-01",), (None,)]
    assert plain_to == (CONNECTION, "events", 8)


def test_jdbc_batch_keys_query():
    session = Recorder()
    jdbc.jdbc_batch_keys(session, CONNECTION, "events", "s-1", 12, 6)
    assert session.calls["dbtable"] == (
        "(SELECT job_id, dates, hours, publisher_id, campaign_id, group_id FROM events "
        "WHERE stream_id = 's-1' AND batch_id = 12) stored"
    )
    split = {"partitionColumn": "hours", "lowerBound": 0, "upperBound": 24, "numPartitions": 6}
    assert split.items() <= session.calls.items()


def test_a_dimension_is_read_once_per_refresh(spark):
    now, reads, path = [0.0], [], scratch(spark, "copies")

    def load():
        reads.append(now[0])
        return spark.createDataFrame([(len(reads), 10)], "job_id int, company_id int")

    loaded = refreshed(load, path, 60.0, lambda: now[0])
    served = []
    for at in (0.0, 30.0, 59.0, 61.0, 100.0, 121.5):
        now[0] = at
        served.append(loaded().first().job_id)
    assert (served, reads) == ([1, 1, 1, 2, 2, 3], [0.0, 61.0, 121.5])
    assert len(names(spark, path)) == 2
    plan = spark.range(5).selectExpr("id as job_id").join(loaded(), "job_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    always = refreshed(load, path, 0, lambda: now[0])
    always(), always()
    assert len(reads) == 5


def test_raw_table_reads_declared_columns(spark, tracking):
    path = scratch(spark, "raw")
    tracking(event()).withColumn("more", F.lit(1)).write.parquet(path)
    assert "more" not in raw_table(spark, "parquet", {"path": path}).columns


def test_stored_dimension_reads_declared_columns(spark):
    path = scratch(spark, "publisher")
    spark.createDataFrame([(1, "x")], "id int, publisher_name string").write.parquet(path)
    publisher = stored_dimension(spark, path, PUBLISHER)
    assert publisher.columns == list(PUBLISHER)
    assert rows_of(publisher, "id", "publisher_name", "email") == [(1, "x", None)]


def test_catalog_tables_apply_defaults(spark, contract):
    tables = create_all(spark, scratch(spark, "catalog"), f"t{uuid.uuid4().hex}_")
    assert create_all(spark, scratch(spark, "catalog"), tables["job"].removesuffix("job")) == tables
    for _ in range(2):
        table_append(contract(event()).drop("updated_at"), tables["events"])
    stored = spark.table(tables["events"]).withColumn("stamped", F.col("updated_at").isNotNull())
    assert rows_of(stored, "id", "sources", "stamped", "clicks") == [(None, "Cassandra", True, 1)] * 2
    assert spark.table(tables["tracking"]).dtypes[0] == ("create_time", "string")


def test_batch_tables_hold_any_columns(spark, contract):
    table = BatchTable(scratch(spark, "fact"), {name: EVENTS[name] for name in EVENTS_WRITTEN})
    table.write(contract(event()), 3)
    assert rows_of(table.read(spark), "batch_id", "job_id", "clicks") == [(3, 1, 1)]
