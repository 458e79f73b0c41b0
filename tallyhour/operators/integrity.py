"""Referential rules of the fact table, as joins.

A missing key is valid, as it is to a database; 0 is a key like any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhour.operators.joins import sized, unique


@dataclass(frozen=True)
class Reference:
    """Facts' ``column`` must be a ``key`` of ``dimension``.

    ``check_size`` counts the keys to decide on a broadcast, for sources of unknown size.
    ``carry`` names dimension columns to bring along, which saves a second join.
    """

    column: str
    dimension: DataFrame
    key: str
    check_size: bool = False
    carry: tuple[str, ...] = ()


def mark(facts: DataFrame, reference: Reference, flag: str) -> DataFrame:
    """Add ``flag``: does the dimension hold the row's key, or is the key missing?

    One left join, from which both halves of a split are filters. The referenced key is
    unique, as a foreign key requires. Both sides reach a shuffled join straight from
    their shuffle, which lets adaptive execution split a key that most facts share; a
    distinct in between would prevent that.
    """
    known = reference.dimension.select(F.col(reference.key).alias(reference.column), *reference.carry)
    known = (sized(known) if reference.check_size else known).withColumn(flag, F.lit(True))
    found = F.coalesce(F.col(flag), F.col(reference.column).isNull())
    return facts.join(known, reference.column, "left").withColumn(flag, found)


def _flag(reference: Reference) -> str:
    return f"{reference.column}_is_known"


def mark_all(facts: DataFrame, references: list[Reference]) -> DataFrame:
    return reduce(lambda frame, reference: mark(frame, reference, _flag(reference)), references, facts)


def split_by_reference(facts: DataFrame, *references: Reference) -> tuple[DataFrame, DataFrame]:
    """Rows all references accept, and the rest with the columns that failed."""
    marked = mark_all(facts, list(references))
    return accepted(marked, *references), rejected(marked, *references)


def accepted(marked: DataFrame, *references: Reference) -> DataFrame:
    flags = [_flag(reference) for reference in references]
    return marked.where(reduce(lambda a, b: a & b, [F.col(flag) for flag in flags])).drop(*flags)


def rejected(marked: DataFrame, *references: Reference) -> DataFrame:
    flags = [_flag(reference) for reference in references]
    failed = F.concat_ws(",", *[F.when(~F.col(_flag(r)), F.lit(r.column)) for r in references])
    return (
        marked.where(~reduce(lambda a, b: a & b, [F.col(flag) for flag in flags]))
        .withColumn("failed_reference", failed)
        .drop(*flags)
    )


def nullify_deleted(facts: DataFrame, surviving: Reference) -> DataFrame:
    """Clear keys whose dimension row is gone; the fact itself stays."""
    flag = _flag(surviving)
    kept = F.when(F.col(flag), F.col(surviving.column))
    return mark(facts, surviving, flag).withColumn(surviving.column, kept).drop(flag).select(*facts.columns)


def remap_keys(facts: DataFrame, column: str, changes: DataFrame) -> DataFrame:
    """Follow key changes given as ``(old_key, new_key)``, one per old key; other keys stay.

    A repeated old key would double its facts, and is refused.
    """
    moves = unique(changes, "old_key").select(F.col("old_key").alias(column), F.col("new_key"))
    return (
        facts.join(moves, column, "left")
        .withColumn(column, F.coalesce("new_key", column))
        .select(*facts.columns)
    )
