"""Checks before a join: of size, for a broadcast, and of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a key and one more narrow column: about 64 MB as a broadcast hash table.
BROADCAST_ROWS = 1_000_000


def sized(narrow: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a narrow frame counted to be small.

    For sources whose size the planner cannot know, such as JDBC. Beyond ``max_rows`` the
    frame is returned as it is and Spark shuffles the join, splitting skewed partitions.
    """
    return F.broadcast(narrow) if narrow.count() <= max_rows else narrow


def unique(dimension: DataFrame, key: str) -> DataFrame:
    """``dimension`` itself, after a check that no key occurs twice.

    A database ensures that by its primary key; files do not, and a repeated key would count facts twice.
    """
    repeated = dimension.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{key} {repeated[0][0]} occurs {repeated[0][1]} times")
    return dimension
