"""The tables, before the first run: ``spark-submit tallyhour/jobs/bootstrap.py --help``."""

from __future__ import annotations

import argparse

from tallyhour.session import build, pin_utc
from tallyhour.sinks.ids import IdRanges
from tallyhour.sinks.tables import create_all


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description="Create raw table, dimensions and fact in the catalog, unless they exist.")
    parser.add_argument("--folder", required=True, help="shared folder of the tables' files")
    parser.add_argument("--prefix", default="", help="put before each table's name, such as a schema and a dot")
    parser.add_argument("--ids-path", help="shared folder of the row id counter, begun after --last-id")
    parser.add_argument("--last-id", type=int, default=0)
    return parser


def main(argv: list[str] | None = None) -> dict[str, str]:
    args = arguments().parse_args(argv)
    spark = pin_utc(build("tallyhour-bootstrap"))
    tables = create_all(spark, args.folder, args.prefix, batches=True)
    if args.ids_path:
        IdRanges(args.ids_path).begin_after(spark, args.last_id)
    return tables


if __name__ == "__main__":
    main()
