"""How late rows arrive, as a sketch that batches can keep and add up.

Lateness is counted in buckets whose bounds grow by a fixed factor, so any quantile is told within ``ACCURACY`` of its
true value, relatively. A sketch has a row per bucket, two thousand at most whatever it counts; merging adds them up.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most by which a quantile may be off, as a share of it.
ACCURACY = 0.01

#: Bucket of rows that are not late at all.
_ON_TIME = -1


def _factor(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def lateness_sketch(rows: DataFrame, arrived: Column, ts: Column, accuracy: float = ACCURACY) -> DataFrame:
    """``bucket, n`` of the milliseconds from ``ts`` to ``arrived``; rows without either are not counted."""
    late = F.unix_millis(arrived) - F.unix_millis(ts)
    bucket = F.when(late <= 0, F.lit(_ON_TIME)).otherwise(F.ceil(F.log(late.cast("double")) / F.lit(math.log(_factor(accuracy)))))
    counted = rows.select(bucket.cast("int").alias("bucket")).where(F.col("bucket").isNotNull())
    return counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    every = reduce(lambda a, b: a.unionByName(b), (sketch.select("bucket", "n") for sketch in sketches))
    return every.groupBy("bucket").agg(F.sum("n").alias("n"))


def lateness_quantiles(sketch: DataFrame, shares: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """``share, late_ms``: all but that share of rows arrive within ``late_ms``, to the sketch's accuracy.

    One task sorts the buckets, which are few by construction. An empty sketch gives no rows.
    """
    factor = _factor(accuracy)
    merged = merge_sketches(sketch)
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.select("bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    asked = F.explode(F.array(*[F.lit(float(share)) for share in shares])).alias("share")
    middle = F.when(F.col("bucket") == _ON_TIME, F.lit(0.0)).otherwise(2 * F.pow(F.lit(factor), F.col("bucket")) / (factor + 1))
    return (
        ranked.select("bucket", "upto", "all", asked)
        .where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("all"))))
        .groupBy("share")
        .agg(F.min("bucket").alias("bucket"))
        .select("share", middle.alias("late_ms"))
    )
