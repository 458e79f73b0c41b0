"""Embedding whitening: leading principal components by Jacobi-Davidson, and rows projected on them.

The covariance is never formed. Every product with it is one pass over the distinct vectors: each task centres its
rows, multiplies them by a block of directions and back, and Spark adds the tasks' sums up. The driver keeps directions
only, a few columns as long as a vector.

Jacobi-Davidson: Rayleigh-Ritz within the search space names the best pairs so far; for each one whose residual is too
large the projected correction equation is solved by a few steps of MINRES, all of them in step, so that one pass
serves the whole block; the solutions widen the space, which is cut back to its best Ritz vectors when it grows too
wide. Pairs whose residual has reached the rounding of a product are locked. The search ends when all wanted are.

Entries are whole numbers (``floor(scale * c)``), so counts, sums and deviations are exact.

Defined cases: a row whose vector is null, empty, or holds a null or a value that is not finite, or so large that
``scale * c`` exceeds 2^53, takes no part and has no rows; of vectors of unlike widths, those of the commonest width (of
two, the wider) take part; a null id keeps its rows; repeated rows are projected each, and count once in the
covariance; components without variance are left out, so that a table of equal rows, or of one, gives no rows, like an
empty one; a deviation beyond 64 bits is null; equal eigenvalues leave their directions free, as any of them is right;
columns not named are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhour.llm.tables import land, own

COMPONENTS = 4
SCALE = 256
#: Pairs followed and corrected beyond those wanted, which need not settle: they keep near eigenvalues apart.
GUARDS = 8
#: The search space is cut back to half of this before it grows beyond it.
WIDEST = 48
INNER_STEPS = 3
ROUNDS = 60
_EPS = float(np.finfo(float).eps)

_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _gathered(fit: DataFrame, width: int, mean: np.ndarray, shape: tuple[int, int], work: Callable) -> np.ndarray:
    """Sum over all rows of what ``work`` makes of a batch of centred rows, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += work(_matrix(batch.column("x"), width) - mean)
        place = pa.array(np.arange(total.size, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([place, pa.array(total.reshape(-1))], names=["place", "value"])

    sums = fit.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    out[sums.column("place").to_numpy()] = sums.column("value").to_numpy()
    return out.reshape(shape)


def _exact_sums(fit: DataFrame, width: int) -> tuple[list[int], int]:
    """Sum of every dimension, and of all squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = [0] * width, 0
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            largest = int(np.abs(x).max(initial=0))
            if largest * largest * max(x.size, 1) >= 1 << 62:
                x = x.astype(object)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0))]
            squares += int((x * x).sum())
        values = [Decimal(v) for v in (*sums, squares)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width + 1), pa.int64()), pa.array(values, pa.decimal128(38, 0))], names=["place", "value"]
        )

    found = fit.mapInArrow(run, "place long, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value"))
    by_place = {row.place: int(row.value) for row in found.collect()}
    return [by_place[i] for i in range(width)], by_place[width]


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Unit columns for what ``new`` adds to the span of ``against``, columns of next to nothing left out."""
    kept = against
    for column in new.T:
        size = np.linalg.norm(column)
        if not np.isfinite(size) or size == 0:
            continue
        column = column / size
        for _ in range(2):
            column = column - kept @ (kept.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            kept = np.column_stack([kept, column])
    return kept[:, against.shape[1] :]


def _corrections(
    product: Callable[[np.ndarray], np.ndarray], around: np.ndarray, values: np.ndarray, residuals: np.ndarray, steps: int, goal: float
) -> np.ndarray:
    """MINRES on ``P (A - value) P t = -residual`` for each column, all columns in step; P projects ``around`` out."""

    def projected(block: np.ndarray) -> np.ndarray:
        return block - around @ (around.T @ block)

    rhs = projected(-residuals)
    beta = np.linalg.norm(rhs, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v, v_before = rhs / first, np.zeros_like(rhs)
    solution, w, w_before = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    width = rhs.shape[1]
    cos, cos_before, sin, sin_before = np.ones(width), np.ones(width), np.zeros(width), np.zeros(width)
    eta, beta = first.copy(), np.zeros(width)
    live = np.linalg.norm(rhs, axis=0) > 0
    for _ in range(steps):
        if not live.any():
            break
        image = projected(product(v) - values * v)
        alpha = (v * image).sum(axis=0)
        image = image - alpha * v - beta * v_before
        beta_next = np.linalg.norm(image, axis=0)
        delta = cos * alpha - cos_before * sin * beta
        rho1 = np.sqrt(delta**2 + beta_next**2)
        rho2, rho3 = sin * alpha + cos_before * cos * beta, sin_before * beta
        live &= rho1 > 0
        rho1 = np.where(rho1 > 0, rho1, 1.0)
        cos_before, cos, sin_before, sin = cos, delta / rho1, sin, beta_next / rho1
        w_before, w = w, (v - rho3 * w_before - rho2 * w) / rho1
        solution = solution + np.where(live, cos * eta, 0.0) * w
        eta = -sin * eta
        live &= (np.abs(eta) > goal * first) & (beta_next > 1e-14 * np.abs(values).max(initial=1.0))
        v_before, v = v, image / np.where(beta_next > 0, beta_next, 1.0)
        beta = beta_next
    return projected(solution)


def leading_pairs(
    product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, trace: float, steps: int = INNER_STEPS
) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The greatest eigenvalues of a symmetric operator with unit eigenvectors, and the residuals they reached.

    ``product`` maps a block of columns. Values of no more than rounding beside ``trace`` are left out.
    """
    wanted = min(wanted, width)
    followed = min(width, wanted + GUARDS)
    space = _orthonormal(np.random.default_rng(13).standard_normal((width, followed)), np.zeros((width, 0)))
    image = product(space)
    tight, stalled, best = 4 * _EPS * np.sqrt(width), 0, np.inf
    for number in range(ROUNDS):
        small = space.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = space @ turn, image @ turn
        residuals = images[:, :followed] - vectors[:, :followed] * values[:followed]
        norms = np.linalg.norm(residuals[:, :wanted], axis=0)
        scale = max(abs(values[0]), _EPS * trace)
        # rounding of the products sets a floor; a residual that stays there has reached double precision
        worst = norms.max() / scale
        stalled, best = (0, worst) if worst < 0.5 * best else (stalled + 1, best)
        open_ = norms > tight * scale
        done = space.shape[1] >= wanted and (not open_.any() or (stalled >= 3 and worst <= 1e-13) or (stalled >= 8 and worst <= 1e-11))
        if done or space.shape[1] == width:
            real = values[:wanted] > width * _EPS * trace
            return values[:wanted][real], vectors[:, :wanted][:, real], (norms / scale)[real].tolist()
        keep = min(space.shape[1], WIDEST // 2)
        if space.shape[1] + followed > max(WIDEST, 2 * followed):
            space, image = vectors[:, :keep], images[:, :keep]
        # locked pairs and the Ritz vectors in work are both kept out of every correction
        open_at = np.flatnonzero(np.append(open_, np.ones(followed - wanted, bool)))
        goal = max(1e-8, 0.1 ** (number + 1))
        found = _corrections(product, vectors[:, :followed], values[open_at], residuals[:, open_at], steps, goal)
        more = _orthonormal(found, space)
        if not more.shape[1]:
            more = _orthonormal(np.random.default_rng(number).standard_normal((width, followed)), space)
        space, image = np.column_stack([space, more]), np.column_stack([image, product(more)])
    raise RuntimeError(f"no convergence within {ROUNDS} rounds")


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of ``(n * x - S)^2`` of each row; None beyond 64 bits."""
    largest = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if largest * largest * x.shape[1] < 1 << 62:
        away = n * x - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def embedding_whitening(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each row and component."""
    rows = own(vectors, {"vec_id": id_column, "embedding": vector_column})
    scaled = F.transform("embedding", lambda c: F.lit(float(scale)) * c.cast("double"))
    unfit = F.exists(scaled, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) > F.lit(2.0**53)), F.lit(True)))
    whole = F.transform(scaled, lambda c: F.floor(c).cast("long"))
    valid = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~unfit).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x")
    )
    nothing = vectors.sparkSession.createDataFrame([], _OUT)
    # copies collapse in every task before they meet
    every = land(valid.select("x").distinct(), "fit")
    sizes = every.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    widest = sizes.orderBy(F.desc("n"), F.desc("width")).first()
    if widest is None:
        return nothing
    width, n = widest["width"], widest["n"]
    fit = every.where(F.size("x") == width)
    sums, squares = _exact_sums(fit, width)
    variance = Fraction(squares, n) - sum(Fraction(s * s, n * n) for s in sums)
    trace = float(variance)
    if not trace:
        return nothing
    mean = np.array([float(Fraction(s, n)) for s in sums])

    def product(block: np.ndarray) -> np.ndarray:
        return _gathered(fit, width, mean, block.shape, lambda away: away.T @ (away @ block)) / n

    values, directions, _ = leading_pairs(product, width, components, trace)
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), range(len(values))] < 0, -1.0, 1.0)
    whitening = directions / np.sqrt(values)
    square = (len(values), len(values))

    def spread(away: np.ndarray) -> np.ndarray:
        white = away @ whitening
        return white.T @ white

    error = float(np.abs(_gathered(fit, width, mean, square, spread) / n - np.eye(len(values))).max(initial=0.0))
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            white = (x - mean) @ whitening
            many = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(many), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * k, n, np.int64)),
                    pa.array([v for one in _deviations(x, n, sums) for v in [one] * k], pa.int64()),
                    pa.array(white.reshape(-1)),
                    pa.array(np.tile(explained, many)),
                    pa.array(np.full(many * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return valid.where(F.size("x") == width).mapInArrow(run, _OUT)
