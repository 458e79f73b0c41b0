"""Small records that are replaced as a whole, by one writer at a time.

Each version is a file of its own, made under another name and then renamed to its number, which fails
if that number is taken. Of two writers that have seen the same version only one can add the next. The
folder must be on storage where a rename does not replace a file, as on HDFS or a POSIX file system.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NAME = re.compile(r"version-(\d{12})\.json")


class Superseded(RuntimeError):
    """Another writer has gone on from the version this one has seen."""


def _located(spark: SparkSession, path: str):
    """The file system of a path, and the path with its scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    system, where = _located(spark, path)
    return sorted(one.getPath().getName() for one in system.listStatus(where)) if system.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    system, where = _located(spark, path)
    system.delete(where, True)


@dataclass(frozen=True)
class Versions:
    path: str

    def _file(self, number: int) -> str:
        return f"{self.path}/version-{number:012d}.json"

    def numbers(self, spark: SparkSession) -> list[int]:
        return [int(found[1]) for found in map(_NAME.fullmatch, names(spark, self.path)) if found]

    def record(self, spark: SparkSession, number: int) -> dict[str, Any]:
        system, where = _located(spark, self._file(number))
        stream = system.open(where)
        try:
            return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self, spark: SparkSession) -> tuple[int, dict[str, Any]]:
        """Number and record of the newest version; -1 and an empty record before the first."""
        found = self.numbers(spark)
        return (found[-1], self.record(spark, found[-1])) if found else (-1, {})

    def add(self, spark: SparkSession, number: int, record: dict[str, Any]) -> None:
        """Make version ``number``; it is an error if another writer has."""
        system, made = _located(spark, f"{self.path}/.new-{uuid.uuid4().hex}")
        _, wanted = _located(spark, self._file(number))
        stream = system.create(made, False)
        try:
            stream.write(bytearray(json.dumps(record).encode()))
        finally:
            stream.close()
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), spark._jsc.hadoopConfiguration())
        keep = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(made, wanted, keep)
        except Py4JJavaError as refused:
            system.delete(made, False)
            if "FileAlreadyExistsException" in refused.java_exception.getClass().getName():
                raise Superseded(f"version {number} of {self.path} was made by another writer") from None
            raise

    def forget(self, spark: SparkSession, keep: int = 10) -> None:
        """Remove all but the newest ``keep`` versions."""
        for number in self.numbers(spark)[:-keep]:
            remove(spark, self._file(number))
