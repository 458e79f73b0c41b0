"""Company of each rollup row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhour.operators.joins import sized


def company_of(job: DataFrame) -> DataFrame:
    """Key and company only: group and campaign always come from the event."""
    return job.select("job_id", "company_id")


def with_company(rollup: DataFrame, job: DataFrame, check_size: bool = False) -> DataFrame:
    """Left join on ``job_id``; rows of an unknown job stay, without a company.

    The rollup is aggregated before it gets here, so a job with a third of all events
    brings only its hour keys. Spark picks broadcast or shuffle by the size it knows;
    ``check_size`` counts the dimension instead, for sources that do not tell theirs.
    """
    companies = company_of(job)
    return rollup.join(sized(companies) if check_size else companies, "job_id", "left")


def with_company_as_of(rollup: DataFrame, history: DataFrame, check_size: bool = False) -> DataFrame:
    """Left join on the company a job had at the row's hour.

    ``history`` holds ``job_id, company_id, valid_from``, an instant or NULL for ever before; a row takes the newest
    entry that is valid by the start of its hour, and none before the first. Of entries valid from one instant the
    greatest company counts. Entries become stretches that do not overlap, so a row meets one at most; a row without
    an hour meets those only that hold from ever before.
    """
    by_job = Window.partitionBy("job_id").orderBy("valid_from")
    stretches = (
        history.groupBy("job_id", "valid_from")
        .agg(F.max("company_id").alias("company_id"))
        .select(F.col("job_id").alias("_job"), "company_id", "valid_from", F.lead("valid_from").over(by_job).alias("valid_to"))
    )
    hour = F.to_timestamp("dates") + F.expr("make_dt_interval(0, hours)")
    timed = rollup.withColumn("_hour", hour)
    since = F.col("valid_from").isNull() | (F.col("_hour") >= F.col("valid_from"))
    until = F.col("valid_to").isNull() | (F.col("_hour") < F.col("valid_to")) | F.col("_hour").isNull()
    met = (F.col("job_id") == F.col("_job")) & since & until
    return timed.join(sized(stretches) if check_size else stretches, met, "left").drop("_job", "_hour", "valid_from", "valid_to")
