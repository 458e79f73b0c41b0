"""The rollup program killed in the middle and started again."""

from __future__ import annotations

import os
import signal
import subprocess
import sys
import time

from support import event, rows_of

from tallyhour.operators.envelope import to_envelope
from tallyhour.operators.rollup import hourly
from tallyhour.schemas import EVENTS, EVENTS_WRITTEN, JOB, ddl
from tallyhour.session import scratch
from tallyhour.sinks.batches import BatchTable
from pyspark.sql import functions as F

FILES = 10
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def batches(folder):
    return [name for _, names, _ in os.walk(folder) for name in names if name.startswith("batch_id=")]


def test_a_killed_program_resumes_without_loss_or_repetition(spark, tracking):
    folder = scratch(spark, "crash")
    raw = tracking(*[event(job=n % 7, bid=0.5, kind=("click", "qualified")[n % 2]) for n in range(200)])
    for n in range(FILES):
        part = raw.where(F.pmod(F.xxhash64("create_time"), F.lit(FILES)) == n)
        to_envelope(part).coalesce(1).write.mode("append").parquet(f"{folder}/topic")
    spark.createDataFrame([(n, 10, 0, 0) for n in range(7)], ddl(JOB)).write.parquet(f"{folder}/job")
    command = [
        sys.executable, "-m", "tallyhour.jobs.rollup", "--topic-format", "parquet", "--once",
        "--topic-option", f"path={folder}/topic", "--topic-option", "maxFilesPerTrigger=1",
        "--checkpoint", f"{folder}/checkpoint", "--job-path", f"{folder}/job", "--events-path", f"{folder}/events",
        "--state-partitions", "2",
    ]
    options = {"cwd": ROOT, "stdout": subprocess.DEVNULL, "stderr": subprocess.DEVNULL, "start_new_session": True}
    first = subprocess.Popen(command, **options)
    deadline = time.monotonic() + 120
    while len(batches(f"{folder}/events")) < 3 and first.poll() is None and time.monotonic() < deadline:
        time.sleep(0.02)
    os.killpg(first.pid, signal.SIGKILL)  # its own session: the program and its JVM
    first.wait()
    done = len(batches(f"{folder}/events"))
    assert 3 <= done < FILES
    assert subprocess.run(command, timeout=180, **options).returncode == 0
    assert len(batches(f"{folder}/events")) == FILES
    fact = {name: EVENTS[name] for name in [*EVENTS_WRITTEN, "updated_at"]}
    added = BatchTable(f"{folder}/events", fact).read(spark).groupBy("job_id", "company_id")
    added = added.agg(*[F.sum(name).alias(name) for name in ("clicks", "qualified_application", "spend_hour")])
    shown = ["job_id", "clicks", "qualified_application", "spend_hour"]
    assert rows_of(added, *shown) == rows_of(hourly(raw), *shown)
