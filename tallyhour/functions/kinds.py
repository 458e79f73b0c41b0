"""Tests on the tracking kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_kind(kind: str, column: str = "custom_track") -> Column:
    """Exact, case-sensitive match; a missing kind is false rather than unknown."""
    return F.col(column).eqNullSafe(F.lit(kind))
