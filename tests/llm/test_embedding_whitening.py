from __future__ import annotations

import math

import numpy as np
import pytest

from tallyhour.llm.embedding_whitening import embedding_whitening, leading_pairs


def by_hand(rows, k=4):
    fit_rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(256 * float(c)) for c in v] for _, v in fit_rows]
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit.astype(float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    white = (np.array(x, float) - np.array([s / n for s in sums])) @ vectors / np.sqrt(values)
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return n, values / np.trace(centred.T @ centred / n), white, deviations, [i for i, _ in fit_rows]


def made(spark, rows, kind="float"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return frame.selectExpr("*", "1L as x", "2 as n", "'c' as component", "3 as place", "4 as value", "5 as width")


def test_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    scales = np.array([3, 2, 1.5, 1.2, 1, 1, 1, 0.9, 0.8, 0.5, 0.5, 0.1])
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=12) * scales)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]  # copies count once
    rows += [(5, rows[9][1]), (None, rows[10][1]), (2000, None), (2001, []), (2002, [1.0, None] * 6), (2003, [math.nan] * 12)]
    rows += [(2004, [math.inf] * 12), (2005, [1.0, 2.0])]
    found = embedding_whitening(made(spark, rows)).collect()
    n, explained, white, deviations, ids = by_hand(rows[:-1])
    assert len(found) == 4 * len(ids) and {r.n for r in found} == {n}
    assert {r.component for r in found} == {1, 2, 3, 4}
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, set()).add(round(r.whitened, 12))
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-12)
        assert r.identity_error < 1e-12
    for column in range(4):
        wanted = white[:, column]
        mine = np.array([next(iter(got[i, d][column + 1])) for i, d in zip(ids, deviations)])
        sign = np.sign(mine[np.abs(wanted).argmax()] * wanted[np.abs(wanted).argmax()])
        assert np.abs(mine - sign * wanted).max() < 1e-10


def test_exact_beyond_doubles(spark):
    rows = [(i, [float(i * 10**8), float(i % 3), 1.0]) for i in range(8)]
    found = embedding_whitening(made(spark, rows, "double")).where("component = 1").collect()
    _, _, _, deviations, ids = by_hand(rows, 2)
    wanted = {i: d if d < 2**63 else None for i, d in zip(ids, deviations)}
    assert {r.vec_id: r.deviation for r in found} == wanted


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 50, [(1, None), (2, [])]])
def test_tables_without_variance(spark, rows):
    assert embedding_whitening(made(spark, rows)).collect() == []


def test_fewer_components_than_asked_for(spark):
    rows = [(i, [float(i), float(i), 0.0]) for i in range(10)]
    found = embedding_whitening(made(spark, rows)).collect()
    assert {r.component for r in found} == {1} and found[0].explained == pytest.approx(1)


def test_huge_entries_take_no_part(spark):
    rows = [(1, [1e300, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    assert {r.vec_id for r in embedding_whitening(made(spark, rows, "double")).collect()} == {2, 3}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("width", [1, 2, 9, 64, 200])
def test_pairs_of_matrices(width, seed):
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.normal(size=(width, width)))
    spectrum = np.sort([rng.uniform(0.9, 1.1, width), rng.exponential(1, width), np.ones(width), 10.0 ** -np.arange(width)][seed])[::-1]
    matrix = turn * spectrum @ turn.T
    matrix = (matrix + matrix.T) / 2
    calls = []

    def product(block):
        calls.append(block.shape[1])
        return matrix @ block

    values, vectors, residuals = leading_pairs(product, width, 4, float(spectrum.sum()))
    many = min(4, width)
    assert np.allclose(values, spectrum[:many], rtol=1e-12, atol=1e-13)
    assert np.abs(vectors.T @ vectors - np.eye(many)).max() < 1e-13
    assert np.linalg.norm(matrix @ vectors - vectors * values, axis=0).max() < 1e-12 * spectrum[0]
    assert len(calls) < 400
