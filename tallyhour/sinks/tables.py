"""Catalog tables with declared columns and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhour.schemas import EVENTS, EVENTS_DEFAULTS, JOB, PUBLISHER, TRACKING, ddl

DEFINITIONS = {"tracking": TRACKING, "job": JOB, "master_publisher": PUBLISHER, "events": EVENTS}


def create_table(
    spark: SparkSession,
    name: str,
    columns: dict[str, str],
    path: str,
    defaults: dict[str, str] | None = None,
    partitioned_by: str | None = None,
) -> str:
    """Create a parquet table at ``path`` unless it exists, and return its name."""
    split = f" PARTITIONED BY ({partitioned_by})" if partitioned_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl(columns, defaults)}) USING parquet{split} LOCATION '{path}'")
    return name


def create_all(spark: SparkSession, folder: str, prefix: str = "", batches: bool = False) -> dict[str, str]:
    """The raw table, both dimensions and the fact, which is split by date.

    With ``batches`` the fact has two columns more, by which a replayed batch is recognised.
    """
    replay = {"stream_id": "string", "batch_id": "bigint"} if batches else {}
    return {
        table: create_table(
            spark,
            f"{prefix}{table}",
            {**columns, **replay} if table == "events" else columns,
            f"{folder}/{table}",
            EVENTS_DEFAULTS if table == "events" else None,
            "dates" if table == "events" else None,
        )
        for table, columns in DEFINITIONS.items()
    }


def table_append(rows: DataFrame, table: str) -> None:
    """Append by column name; columns the rows lack take the table's defaults."""
    names = ", ".join(f"`{name}`" for name in rows.columns)
    split = "dates" in rows.columns
    chosen = rows.hint("rebalance", "dates") if split else rows
    rows.sparkSession.sql(f"INSERT INTO {table} ({names}) SELECT {names} FROM {{rows}}", rows=chosen)
