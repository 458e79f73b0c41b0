"""The scan cursor in shared storage, safe against a second poller."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyhour.functions import EPOCH, iso_text, parse_iso
from tallyhour.sinks.versions import Superseded, Versions

__all__ = ["CursorState", "CursorTable", "Superseded"]


@dataclass(frozen=True)
class CursorState:
    """What a poller has seen: it may only go on from there."""

    version: int
    last_scan_time: str
    snapshot_until: str | None
    lease: int


@dataclass(frozen=True)
class CursorTable:
    """A version for each save, which only one poller can make: the cursor never moves back or past unsent rows.

    A poller that starts takes a lease, which makes a version too. Any other poller is then behind: its next save, and
    with a lease its next look, is refused with ``Superseded``. What it published in between comes twice
    and is never lost. A save that fails midway leaves no version.
    """

    path: str

    def _versions(self) -> Versions:
        return Versions(self.path)

    def state(self, spark: SparkSession, lease: int | None = None) -> CursorState:
        """The newest state; with ``lease``, only while no other poller has taken one since."""
        number, record = self._versions().newest(spark)
        found = CursorState(number, record.get("last_scan_time", EPOCH), record.get("snapshot_until"), record.get("lease", 0))
        if lease is not None and found.lease != lease:
            raise Superseded(f"lease {lease} was taken over by lease {found.lease}")
        return found

    def load(self, spark: SparkSession) -> str:
        """ISO-8601 text of the cursor; the epoch before the first save."""
        return self.state(spark).last_scan_time

    def snapshot_until(self, spark: SparkSession) -> str | None:
        """Where a first load in spans ends, while it lasts."""
        return self.state(spark).snapshot_until

    def take_lease(self, spark: SparkSession) -> int:
        """Shut out all pollers so far; the number that this one gives with its looks."""
        while True:
            seen = self.state(spark)
            try:
                self._add(spark, seen, seen.last_scan_time, seen.snapshot_until, seen.lease + 1)
                return seen.lease + 1
            except Superseded:
                continue

    def save(
        self, spark: SparkSession, cursor: str, snapshot_until: str | None = None, seen: CursorState | None = None
    ) -> None:
        """Go on from ``seen``, or from the newest state; refused if another poller has gone on from there."""
        seen = seen or self.state(spark)
        text = spark.range(1).select(iso_text(parse_iso(F.lit(cursor)))).first()[0]
        self._add(spark, seen, text, snapshot_until, seen.lease)

    def _add(self, spark: SparkSession, seen: CursorState, text: str, snapshot_until: str | None, lease: int) -> None:
        record = {"last_scan_time": text, "snapshot_until": snapshot_until, "lease": lease}
        self._versions().add(spark, seen.version + 1, record)
        self._versions().forget(spark)
