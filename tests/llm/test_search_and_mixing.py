from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from tallyhour.llm.exact_topk import exact_topk
from tallyhour.llm.mix_sources import mix_sources, poisson_cdf, source_rates


def brute_force(rows, k, modulus):
    valid = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    lists = []
    for place, (query, q) in enumerate(valid):
        if query % modulus == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), i) for other, (i, c) in enumerate(valid) if other != place)[:k]
            lists.append((query, [(i, -s) for s, i in scored]))
    return sorted(lists)


def listed(found):
    lists: dict = {}
    for r in sorted(found, key=lambda r: r.rank):
        lists.setdefault((r.query_row, r.query_id), []).append((r.vec_id, r.score))
    return sorted((query, one) for (_, query), one in lists.items())


@pytest.mark.parametrize("sizes", [(4096, 128, 4096), (17, 4, 3)])
def test_topk_equals_brute_force(spark, sizes):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 4, 1) for _ in range(rng.choice([6, 6, 6, 4]))], i % 4) for i in range(120)]
    rows += [(7, rows[3][1], 0), (40, rows[2][1], None), (200, None, 1), (201, [], 1), (202, [1.0, None], 2), (203, [math.nan], 0), (204, [math.inf], 0), (None, [1.0], 0)]
    rows += [(300 + i, [1.0] * 6, 9) for i in range(40)]  # ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as part", "2 as score", "3 as cluster")
    part_rows, block_rows, chunk = sizes
    rows += [(40, rows[5][1], 1), (60, [], 2), (60, [0.5] * 6, 2)]
    frame = frame.unionByName(spark.createDataFrame(rows[-3:], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as part", "2 as score", "3 as cluster"))
    found = exact_topk(frame, k=5, query_modulus=10, part_rows=part_rows, block_rows=block_rows, query_chunk=chunk).collect()
    assert listed(found) == brute_force([row[:2] for row in rows], 5, 10)


def test_topk_by_a_cluster_of_text(spark):
    rows = [(i, [float(i % 7), 1.0], f"name {i % 3}" if i % 5 else None) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = exact_topk(frame, k=4, query_modulus=10, part_rows=10, block_rows=4).collect()
    assert listed(found) == brute_force([row[:2] for row in rows], 4, 10)


def test_topk_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert listed(exact_topk(frame).collect()) == [(0, [(1, 64 * 128)])]
    assert exact_topk(frame.limit(0)).count() == 0
    assert exact_topk(frame.where("vec_id = 0")).count() == 0


def test_poisson_probabilities(spark):
    for mean in (0.0, 0.3, 4.0, 480.0):
        cdf = spark.range(1).selectExpr(f"{mean}D as m").select(poisson_cdf("m" and __import__("pyspark").sql.functions.col("m"))).first()[0]
        logs = [k * math.log(mean) - mean - math.lgamma(k + 1) if mean else (0.0 if k == 0 else -math.inf) for k in range(len(cdf))]
        total = 0.0
        for k, log in enumerate(logs):
            total += math.exp(log)
            assert cdf[k] == pytest.approx(total, abs=1e-9)
        assert cdf[-1] == pytest.approx(1, abs=1e-12)


def test_shares_follow_the_weights(spark, documents):
    rows = documents(*[(n, "x" * 9, "en", "big" if n % 10 else "small") for n in range(3000)])
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    rates = {r.source_key: r.rate for r in source_rates(rows, weights).collect()}
    assert rates == {"=big": pytest.approx(0.25 / 0.9), "=small": pytest.approx(7.5)}
    counts = Counter(r.source for r in mix_sources(rows, weights).collect())
    assert counts["big"] == pytest.approx(750, rel=0.15) and counts["small"] == pytest.approx(2250, rel=0.1)
    far = spark.createDataFrame([("small", 1.0)], "source string, weight double")
    drawn = mix_sources(rows.where("doc_id < 20"), far, size_factor=500.0)
    assert drawn.count() == pytest.approx(10000, rel=0.05)  # a mean of 5,000, drawn in parts


def test_mixing_cases(documents):
    rows = documents((1, "a"), (1, "a"), (None, None, None, None), (2, "", "en", None))
    found = mix_sources(rows, size_factor=6.0)
    assert found.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    result = found.collect()
    assert Counter((r.doc_id, r.copy) for r in result if r.doc_id == 1) == {(1, k): 2 for k in range(1, 1 + max(r.copies for r in result if r.doc_id == 1))}
    assert sorted(map(str, result)) == sorted(map(str, mix_sources(rows, size_factor=6.0).collect()))
    assert mix_sources(rows.limit(0)).count() == 0
