"""Raw table to change topic: ``spark-submit tallyhour/jobs/capture.py --help``."""

from __future__ import annotations

import argparse

from tallyhour.jobs.options import option_map
from tallyhour.plans.capture import POLL_SECONDS, poll, run_increment
from tallyhour.session import build
from tallyhour.sinks.cursor import CursorTable
from tallyhour.sinks.ledger import SentLedger
from tallyhour.sinks.topic import publish
from tallyhour.sources.raw import raw_stream, raw_table
from tallyhour.streaming.capture import publish_stream


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description="Publish new tracking rows as change messages.")
    parser.add_argument("--raw-format", required=True, help="connector of the raw table")
    parser.add_argument("--raw-option", action="append", default=[], metavar="KEY=VALUE")
    parser.add_argument("--topic-format", default="kafka")
    parser.add_argument("--topic-option", action="append", default=[], metavar="KEY=VALUE")
    place = parser.add_mutually_exclusive_group(required=True)
    place.add_argument("--cursor", help="shared folder of the scan cursor; the table is polled")
    place.add_argument("--stream-checkpoint", help="shared folder of a stream's progress; the table is read as a stream")
    parser.add_argument("--once", action="store_true", help="of a stream: stop at the present end of the table")
    parser.add_argument("--settle", default="2 seconds", help="how late a row may arrive and still be sent")
    parser.add_argument(
        "--overlap",
        default="1 hour",
        help="look again at this stretch before the cursor, for rows that arrive late",
    )
    parser.add_argument("--resend", action="store_true", help="send all of the overlap at every poll; readers drop the copies")
    parser.add_argument("--span", help="most time one increment may cover, such as '1 day', for a long first scan")
    parser.add_argument("--strict", action="store_true", help="scan ts > cursor only, without settling time or overlap")
    parser.add_argument("--seconds", type=float, default=POLL_SECONDS, help="time between polls")
    parser.add_argument("--polls", type=int, help="stop after this many polls")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = build("tallyhour-capture")
    topic = option_map(args.topic_option)
    if args.stream_checkpoint:
        trigger = {"availableNow": True} if args.once else {}
        raw = raw_stream(spark, args.raw_format, option_map(args.raw_option))
        query = publish_stream(raw, topic, args.stream_checkpoint, args.topic_format, **trigger)
        query.awaitTermination()
        return sum(batch["numInputRows"] for batch in query.recentProgress)
    cursors = CursorTable(args.cursor)
    ledger = None if args.resend else SentLedger(f"{args.cursor.rstrip('/')}/ledger")
    lease = cursors.take_lease(spark)

    def increment():
        # read anew for each poll, so that new files or splits of the table are seen
        raw = raw_table(spark, args.raw_format, option_map(args.raw_option))
        return run_increment(
            raw,
            cursors,
            lambda messages: publish(messages, topic, args.topic_format),
            settle=args.settle,
            overlap=args.overlap,
            span=args.span,
            strict=args.strict,
            ledger=ledger,
            lease=lease,
        )

    return poll(increment, args.polls, args.seconds)


if __name__ == "__main__":
    main()
