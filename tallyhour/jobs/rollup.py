"""Change topic to fact table: ``spark-submit tallyhour/jobs/rollup.py --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhour.jobs.options import option_map
from tallyhour.plans.batch import BatchSink, deliver
from tallyhour.schemas import EVENTS, EVENTS_WRITTEN, PUBLISHER
from tallyhour.session import build, for_state, scratch
from tallyhour.sinks.batches import BatchTable, tally_table
from tallyhour.sinks.jdbc import jdbc_plain_sink, jdbc_sink
from tallyhour.sources.dimension import JOB_QUERY, jdbc_bounds, jdbc_dimension, jdbc_table, refreshed, stored_dimension
from tallyhour.sources.topic import topic_stream
from tallyhour.streaming.rollup import run_rollup


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description="Roll changes up by hour and append them to the fact table.")
    parser.add_argument("--topic-format", default="kafka")
    parser.add_argument("--topic-option", action="append", default=[], metavar="KEY=VALUE")
    parser.add_argument("--checkpoint", required=True, help="shared folder of the query's progress")
    parser.add_argument("--jdbc-option", action="append", default=[], metavar="KEY=VALUE", help="url, driver, user, password")
    parser.add_argument("--jdbc-table", default="events")
    parser.add_argument("--jdbc-connections", type=int, default=8, help="parallel writers")
    parser.add_argument("--dates-as-text", action="store_true", help="for a target that keeps dates as text")
    parser.add_argument("--plain-append", action="store_true", help="for a target without stream_id and batch_id; replays append again")
    parser.add_argument("--job-path", help="job dimension as parquet, instead of over JDBC")
    parser.add_argument("--publisher-path", help="publisher dimension as parquet, instead of over JDBC")
    parser.add_argument("--refresh", type=float, default=60.0, help="seconds for which a copy of the dimensions serves; 0 for each batch anew")
    parser.add_argument("--dimension-connections", type=int, default=1, help="connections that read a dimension over JDBC, split by its key")
    parser.add_argument("--events-path", help="fact table as parquet batches, instead of over JDBC")
    parser.add_argument("--tally-path", help="state rows as parquet batches for jobs/compact.py, instead of fact rows")
    parser.add_argument("--dead-letter-path", help="folder for messages that cannot be read, with the reason")
    parser.add_argument("--quarantine-path", help="folder for rows whose job or publisher is unknown")
    parser.add_argument(
        "--dedup-horizon",
        default="2 hours",
        help="drop copies of a change arriving within this time; more than the overlap of the capture",
    )
    parser.add_argument("--no-dedup", action="store_true", help="for a topic without copies: count every message")
    parser.add_argument("--state-partitions", type=int, help="partitions of the dedup state, fixed by the first start")
    parser.add_argument("--trigger", help="processing time between batches, such as '2 seconds'")
    parser.add_argument("--once", action="store_true", help="stop at the present end of the topic")
    return parser


def _stamped(table: BatchTable) -> BatchSink:
    def write(rows: DataFrame, batch_id: int) -> None:
        table.write(rows.withColumn("updated_at", F.current_timestamp()), batch_id)

    return write


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = build("tallyhour-rollup")
    horizon = None if args.no_dedup else args.dedup_horizon
    if horizon:
        spark = for_state(spark, args.state_partitions)
    jdbc = option_map(args.jdbc_option)
    fact = {name: EVENTS[name] for name in [*EVENTS_WRITTEN, "updated_at"]}

    def over_jdbc(table: str, key: str, query: str):
        if args.dimension_connections == 1:
            return jdbc_dimension(spark, jdbc, query)
        bounds = jdbc_bounds(spark, jdbc, table, key)
        return jdbc_table(spark, jdbc, f"({query}) dimension", key, bounds, args.dimension_connections)

    def load_job():
        return stored_dimension(spark, args.job_path) if args.job_path else over_jdbc("job", "job_id", JOB_QUERY)

    def load_publisher():
        if args.publisher_path:
            return stored_dimension(spark, args.publisher_path, PUBLISHER)
        return over_jdbc("master_publisher", "id", "SELECT id FROM master_publisher")

    copies = scratch(spark, "dimensions")
    load_job, load_publisher = (
        refreshed(load, f"{copies}/{name}", args.refresh) for name, load in (("job", load_job), ("publisher", load_publisher))
    )

    if args.events_path:
        write = BatchTable(args.events_path, fact).write
    else:
        jdbc_target = jdbc_plain_sink if args.plain_append else jdbc_sink
        write = jdbc_target(jdbc, args.jdbc_table, args.jdbc_connections, args.dates_as_text)
    quarantine = landing = None
    if args.quarantine_path:
        quarantine = _stamped(BatchTable(args.quarantine_path, {**fact, "failed_reference": "string"}))
        landing = args.quarantine_path.rstrip("/") + "-landing"
    # copies are files, whose size Spark knows
    sink = deliver(load_job, write, load_publisher, quarantine, landing)
    if args.tally_path:
        sink = tally_table(args.tally_path).write
    dead = dead_landing = None
    if args.dead_letter_path:
        dead = BatchTable(args.dead_letter_path, {"reason": "string", "value": "binary"}).write
        dead_landing = args.dead_letter_path.rstrip("/") + "-landing"
    trigger = {"availableNow": True} if args.once else {"processingTime": args.trigger} if args.trigger else {}
    topic = topic_stream(spark, option_map(args.topic_option), args.topic_format)
    run_rollup(topic, sink, args.checkpoint, horizon, dead, dead_landing, **trigger).awaitTermination()


if __name__ == "__main__":
    main()
