"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query runs once to warm
up and then ``BENCH_RUNS`` times; the median counts. Results go to Spark's noop sink, so
every row and column is computed. ``rates`` adds rows per second of the batch rollup and
the duration of a 50-record micro-batch, the only figures with a published counterpart.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from tallyhour.operators.envelope import to_envelope
from tallyhour.plans import inputs
from tallyhour.plans.queries import queries
from tallyhour.session import build, scratch
from tallyhour.sinks.batches import tally_table
from tallyhour.sources.topic import topic_stream
from tallyhour.streaming.rollup import run_rollup

HEADLINE = [
    "hourly_rollup",
    "rollup_with_company",
    "events_written",
    "events_contract",
    "reference_failures",
    "nullify_deleted_jobs",
    "remap_job_keys",
    "envelope_build",
    "envelope_parse",
    "bad_records_dropped",
    "publish_and_read_back",
    "incremental_scan",
    "next_cursor",
    "cursor_round_trip",
    "deduped_changes",
    "stream_parse",
    "stream_deltas_compacted",
    "stream_replay_idempotent",
    "stream_deduped",
    "compacted_table",
    "stream_events_appended",
    "table_append_with_defaults",
]


def run_all(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def small_batches(spark: SparkSession, sf_dir: str, records: int = 50, batches: int = 12) -> dict[str, float]:
    """Micro-batches of ``records`` messages each, as the stream itself reports them."""
    folder = scratch(spark, "latency")
    rows = inputs.tracking(spark, sf_dir).limit(records * batches)
    to_envelope(rows).coalesce(1).write.option("maxRecordsPerFile", records).parquet(f"{folder}/topic")
    topic = topic_stream(spark, {"path": f"{folder}/topic", "maxFilesPerTrigger": "1"}, "parquet")
    query = run_rollup(topic, tally_table(f"{folder}/tallies").write, f"{folder}/checkpoint", availableNow=True)
    query.awaitTermination()
    durations = [batch["durationMs"]["triggerExecution"] for batch in query.recentProgress if batch["numInputRows"]]
    warm = durations[2:] or durations
    return {"records": records, "batches": len(durations), "median_ms": statistics.median(warm), "max_ms": max(warm)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = queries()
    seconds = {}
    for name in HEADLINE:
        run_all(registry[name](spark, sf_dir))
        samples = [timed(lambda: run_all(registry[name](spark, sf_dir))) for _ in range(runs)]
        seconds[name] = round(statistics.median(samples), 3)
    n_events = inputs.tracking(spark, sf_dir).count()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "rates": {
            "events": n_events,
            "rollup_rows_per_sec": round(n_events / seconds["hourly_rollup"]),
            "envelope_parse_rows_per_sec": round(n_events / seconds["envelope_parse"]),
            "stream_rows_per_sec": round(n_events / seconds["stream_deltas_compacted"]),
            "micro_batch": small_batches(spark, sf_dir),
        },
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
