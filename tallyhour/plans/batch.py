"""Batch pipelines: raw rows to fact rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyhour.operators.contract import to_events_contract
from tallyhour.operators.enrich import with_company
from tallyhour.operators.integrity import Reference, accepted, mark_all, rejected
from tallyhour.operators.rollup import hourly, measures

Loader = Callable[[], DataFrame]
BatchSink = Callable[[DataFrame, int], None]


def hourly_events(tracking: DataFrame, job: DataFrame) -> DataFrame:
    """Raw rows to the written columns of the fact, in one pass over the raw rows."""
    return to_events_contract(with_company(hourly(tracking), job))


def deliver(
    load_job: Loader,
    write: BatchSink,
    load_publisher: Loader | None = None,
    quarantine: BatchSink | None = None,
    landing: str | None = None,
    check_size: bool = False,
) -> BatchSink:
    """A micro-batch sink: tallies to fact rows, with references checked if asked.

    Dimensions are loaded anew for each batch, so a job added later is seen by later
    batches. With ``quarantine``, rows the target's foreign keys would refuse go there
    rather than failing the batch; one join with the jobs then gives both the company and
    the check. Accepted and refused rows are both read from ``landing``, a folder of this
    query on shared storage that each batch overwrites, so the batch is computed once.
    """
    if quarantine is None:
        return lambda tallies, batch_id: write(
            to_events_contract(with_company(measures(tallies), load_job(), check_size)), batch_id
        )
    if landing is None:
        raise ValueError("a quarantine needs a landing folder")

    def sink(tallies: DataFrame, batch_id: int) -> None:
        references = [Reference("job_id", load_job(), "job_id", check_size, carry=("company_id",))]
        if load_publisher is not None:
            references.append(Reference("publisher_id", load_publisher(), "id", check_size))
        marked = mark_all(measures(tallies), references)
        marked.write.mode("overwrite").parquet(landing)
        landed = tallies.sparkSession.read.schema(marked.schema).parquet(landing)
        write(to_events_contract(accepted(landed, *references)), batch_id)
        quarantine(rejected(landed, *references), batch_id)

    return sink
