"""A table split by date whose dates are replaced together, in one step."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhour.operators.joins import sized
from tallyhour.schemas import ddl
from tallyhour.sinks.versions import Superseded, Versions, names, remove

#: Spark's name of the folder for rows without a date.
_NO_DATE = "dates=__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Snapshot:
    """Which folder holds each date, and what the last writer noted beside it."""

    version: int = -1
    folders: dict[str, str] = field(default_factory=dict)
    notes: dict[str, Any] = field(default_factory=dict)


def date_folder(date: str | None) -> str:
    return _NO_DATE if date is None else f"dates={date}"


def dates_of(rows: DataFrame) -> list[str | None]:
    """The dates that rows fall on, as text. There are as many as days, however many rows."""
    return [row[0] for row in rows.select(F.col("dates").cast("string")).distinct().collect()]


@dataclass(frozen=True)
class DatedTable:
    """Parquet below ``path/data``: a folder for each write, and in it one for each date it wrote.

    A record names, for every date, the write that holds it. Readers take the newest record and read the folders
    it names; a writer adds folders and then a record, by one rename. Stopped in between it leaves folders that no
    record names. Of two writers that began with one record the second is refused, and can begin anew.
    """

    path: str
    columns: dict[str, str]

    def _versions(self) -> Versions:
        return Versions(f"{self.path}/versions")

    def snapshot(self, spark: SparkSession) -> Snapshot:
        number, record = self._versions().newest(spark)
        return Snapshot(number, record.get("folders", {}), record.get("notes", {}))

    def read(self, spark: SparkSession, snapshot: Snapshot | None = None, dates: Iterable[str | None] | None = None) -> DataFrame:
        """Rows of all dates, or of the given ones only."""
        snapshot = snapshot or self.snapshot(spark)
        wanted = snapshot.folders if dates is None else {date_folder(date) for date in dates} & set(snapshot.folders)
        paths = [f"{self.path}/data/write={snapshot.folders[name]}/{name}" for name in sorted(wanted)]
        if not paths:
            return spark.createDataFrame([], ddl(self.columns))
        others = {name: kind for name, kind in self.columns.items() if name != "dates"}
        reader = spark.read.schema(ddl({**others, "write": "string", "dates": "date"}))
        return reader.option("basePath", f"{self.path}/data").parquet(*paths).select(*self.columns)

    def replace(
        self,
        rows: DataFrame,
        snapshot: Snapshot,
        dates: Iterable[str | None] = (),
        notes: dict[str, Any] | None = None,
        before_switch: Callable[[], None] | None = None,
    ) -> Snapshot:
        """Put ``rows`` in place of the dates they fall on, and of ``dates``, for all readers at once.

        ``snapshot`` is what the rows were made from; if another writer has gone on from it, ``Superseded`` is
        raised and nothing changes. The rebalance keeps files large and splits a date that holds most of the rows.
        """
        spark = rows.sparkSession
        write = uuid.uuid4().hex
        folder = f"{self.path}/data/write={write}"
        rows.select(*self.columns).hint("rebalance", "dates").write.partitionBy("dates").parquet(folder)
        made = [name for name in names(spark, folder) if name.startswith("dates=")]
        gone = {date_folder(date) for date in dates} - set(made)
        folders = {name: held for name, held in snapshot.folders.items() if name not in gone} | dict.fromkeys(made, write)
        notes = snapshot.notes if notes is None else notes
        if before_switch:
            before_switch()
        self._versions().add(spark, snapshot.version + 1, {"folders": folders, "notes": notes})
        return Snapshot(snapshot.version + 1, folders, notes)

    def append(self, rows: DataFrame) -> Snapshot:
        """Add rows to what their dates hold."""
        spark = rows.sparkSession
        while True:
            seen = self.snapshot(spark)
            dates = dates_of(rows)
            try:
                return self.replace(self.read(spark, seen, dates).unionByName(rows.select(*self.columns)), seen)
            except Superseded:
                continue

    def rewrite(
        self,
        spark: SparkSession,
        touched: Callable[[DataFrame], DataFrame],
        change: Callable[[DataFrame], DataFrame],
        once: str | None = None,
    ) -> Snapshot:
        """Copy the dates that hold ``touched`` rows, changed; files of all other dates stay as they are.

        ``touched`` reads only the columns it needs of the whole table; ``change`` gets the rows of those dates.
        ``once`` names a change that must not be made twice: the table notes it in the same step.
        """
        while True:
            seen = self.snapshot(spark)
            done = seen.notes.get("done", [])
            dates = [] if once in done else dates_of(touched(self.read(spark, seen)))
            if not dates:
                return seen
            notes = {**seen.notes, "done": [*done, once]} if once else None
            try:
                return self.replace(change(self.read(spark, seen, dates)), seen, dates, notes)
            except Superseded:
                continue

    def expire(self, spark: SparkSession, keep: int = 2) -> None:
        """Remove folders that none of the newest ``keep`` records names, and the records before these.

        Readers of those records are not disturbed. Run it while no writer is at work: a folder whose record
        is still to come looks like one that was left behind.
        """
        versions = self._versions()
        versions.forget(spark, keep)
        held = {f"write={write}" for number in versions.numbers(spark) for write in versions.record(spark, number)["folders"].values()}
        for name in names(spark, f"{self.path}/data"):
            if name.startswith("write=") and name not in held:
                remove(spark, f"{self.path}/data/{name}")


def holding(column: str, keys: DataFrame, check_size: bool = True) -> Callable[[DataFrame], DataFrame]:
    """Rows whose ``column`` is one of ``keys`` (a single column)."""
    named = keys.toDF(column).distinct()
    chosen = sized(named) if check_size else named
    return lambda facts: facts.join(chosen, column, "left_semi")
