"""Ranges of row ids handed out to appenders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from tallyhour.sinks.versions import Superseded, Versions


@dataclass(frozen=True)
class IdRanges:
    """A counter in shared storage. Ids are unique across appenders, and nothing reads the rows stored so far.

    A range is never handed out twice: an append that fails leaves a gap, as a database sequence does.
    """

    path: str

    def reserve(self, spark: SparkSession, n: int) -> int:
        """The id before a range of ``n`` that is now the caller's."""
        if n < 0:
            raise ValueError(f"a range of {n}")
        versions = Versions(self.path)
        while True:
            number, record = versions.newest(spark)
            last = record.get("last", 0)
            if not n:
                return last
            try:
                versions.add(spark, number + 1, {"last": last + n})
            except Superseded:
                continue
            versions.forget(spark)
            return last

    def begin_after(self, spark: SparkSession, last: int) -> None:
        """Begin after the ids of a table that is there already; only before the first range."""
        Versions(self.path).add(spark, 0, {"last": last})
