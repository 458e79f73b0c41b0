"""Tally batches to a table by date, and its measures: ``spark-submit tallyhour/jobs/compact.py --help``."""

from __future__ import annotations

import argparse

from tallyhour.operators.contract import to_events_contract
from tallyhour.operators.enrich import with_company
from tallyhour.plans.capture import Increment, poll
from tallyhour.session import build, pin_utc
from tallyhour.sinks.batches import tally_table
from tallyhour.sinks.compaction import compact_batches, compacted_table, expire_batches, served
from tallyhour.sources.dimension import stored_dimension


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description="Merge finished tally batches by date and remove what is merged.")
    parser.add_argument("--tally-path", required=True, help="batches that the rollup writes")
    parser.add_argument("--table-path", required=True, help="shared folder of the merged table")
    parser.add_argument("--expire", action="store_true", help="remove merged batches and copies that no reader needs")
    parser.add_argument("--serve-path", help="also write the fact rows of all hour keys so far to this folder")
    parser.add_argument("--job-path", help="job dimension as parquet, for the company of served rows")
    parser.add_argument("--seconds", type=float, default=600.0, help="time between runs")
    parser.add_argument("--runs", type=int, help="stop after this many runs")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    if args.serve_path and not args.job_path:
        raise SystemExit("--serve-path needs --job-path")
    spark = pin_utc(build("tallyhour-compact"))
    tallies, table = tally_table(args.tally_path), compacted_table(args.table_path)

    def run() -> Increment:
        compact_batches(spark, tallies, table)
        if args.expire:
            expire_batches(spark, tallies, table)
            table.expire(spark)
        if args.serve_path:
            rows = with_company(served(spark, tallies, table), stored_dimension(spark, args.job_path))
            to_events_contract(rows).write.mode("overwrite").parquet(args.serve_path)
        return Increment("", "", 0)

    poll(run, args.runs, args.seconds)


if __name__ == "__main__":
    main()
