from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F
from support import at

from tallyhour.operators.lateness import lateness_quantiles, lateness_sketch, merge_sketches

SHARES = [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]


def sketch(spark, delays, accuracy=0.01):
    rows = spark.createDataFrame([(d,) for d in delays], "ms long").withColumn("ts", F.lit(at("2025-10-01T00:00:00")))
    arrived = F.timestamp_millis(F.unix_millis("ts") + F.col("ms"))
    return lateness_sketch(rows, arrived, F.col("ts"), accuracy)


@pytest.mark.parametrize("accuracy", [0.01, 0.1])
def test_quantiles_within_the_stated_error(spark, accuracy):
    rng = random.Random(2)
    delays = [int(rng.paretovariate(0.4)) for _ in range(3000)] + [0, -5000, 1, None]
    parts = [sketch(spark, delays[i::3], accuracy) for i in range(3)]
    found = {r.share: r.late_ms for r in lateness_quantiles(merge_sketches(*parts), SHARES, accuracy).collect()}
    known = sorted(max(d, 0) for d in delays if d is not None)
    for share in SHARES:
        exact = known[max(1, math.ceil(share * len(known))) - 1]
        assert abs(found[share] - exact) <= accuracy * exact + 1e-9


def test_sketches_are_small_and_may_be_empty(spark):
    huge = sketch(spark, [2**n for n in range(53)] + list(range(5000)))
    assert huge.count() < 2000
    assert lateness_quantiles(sketch(spark, [None]), SHARES).count() == 0
