"""Changes of jobs and publishers followed in the stored fact.

Each function copies only the dates that hold a row to change and switches to the copies in one step; files of all
other dates stay. Which dates those are is found by a join that reads the dates and one key column of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhour.operators.enrich import company_of
from tallyhour.operators.integrity import Reference, mark, nullify_deleted, remap_keys
from tallyhour.operators.joins import sized, unique
from tallyhour.sinks.dated import DatedTable, Snapshot, holding


def nullify_stored(spark: SparkSession, table: DatedTable, surviving: Reference) -> Snapshot:
    """Clear stored keys whose dimension row is gone. Repeating it finds nothing to do."""

    def touched(facts: DataFrame) -> DataFrame:
        return mark(facts.select("dates", surviving.column), surviving, "known").where(~F.col("known"))

    return table.rewrite(spark, touched, lambda facts: nullify_deleted(facts, surviving))


def remap_stored(spark: SparkSession, table: DatedTable, column: str, changes: DataFrame, change_id: str) -> Snapshot:
    """Follow key changes ``(old_key, new_key)`` in stored rows.

    A key may be both old and new (1 to 2, 2 to 3), so applying changes again would move rows twice: ``change_id``
    names them, and a table that has seen that name is left as it is.
    """
    moved = unique(changes, "old_key").where(F.col("old_key") != F.col("new_key"))
    return table.rewrite(
        spark, holding(column, moved.select("old_key")), lambda facts: remap_keys(facts, column, moved), once=change_id
    )


def backfill_company(spark: SparkSession, table: DatedTable, job: DataFrame) -> Snapshot:
    """Give rows stored without a company that of their job, once the job is known. Other rows keep theirs."""
    known = sized(unique(company_of(job).where(F.col("company_id").isNotNull()), "job_id"))

    def touched(facts: DataFrame) -> DataFrame:
        return facts.where(F.col("company_id").isNull()).join(known, "job_id", "left_semi")

    def filled(facts: DataFrame) -> DataFrame:
        found = facts.join(known.withColumnRenamed("company_id", "found_company"), "job_id", "left")
        return found.withColumn("company_id", F.coalesce("company_id", "found_company")).select(*facts.columns)

    return table.rewrite(spark, touched, filled)
