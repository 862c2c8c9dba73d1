"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are never factored: a step takes the driver's newest right
vector v to the rows, where Xv, what is left of it beside the earlier left
vectors, and Xᵀ of that are added up in one pass.

    u_j = (X v_j - b_(j-1) u_(j-1) - U t) / a_j        v_(j+1) = (Xᵀ u_j - a_j v_j - V s) / b_j

A left vector has a number for each row; it is not stored but made again from
the rows, as u_j = X y_j with y_j on the driver.  Full reorthogonalisation:
the right vectors twice against all before, the left ones by the inner products
measured over the rows (UᵀU is measured as well, so the second round needs no
pass).  Vectors on the driver are as long as a row; a pass brings back a few
times that many numbers, added up by Spark.  The small bidiagonal matrix of the
a and b has X's singular values, and its right singular vectors give the
components.

All numbers of rows are whole (see ``whiten``), so sums, counts and deviations
are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyframe.llm.blocks import commonest_size, finite, packed, totals, vectors, whole_numbers

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Products of a component and the scale beyond this count as it.
BOUND = 1 << 40
#: Up to so many dimensions all steps are made, which finds equal deviations as well.
FULL_STEPS = 256
#: Beyond, the rest of a component that has come out, as a share of the greatest deviation.
TOLERANCE = 1e-14
#: A component whose deviation is under this share of the greatest has none.
FLAT = 1e-9
#: What is left of a vector under this share of the greatest is rounding alone: the next one starts afresh.
BREAK = 1e-12
SEED = 12


@dataclass(frozen=True)
class Whitening:
    """What whitening needs besides a row: number of rows, sums, components (dim x k), variances, share of each."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def differences(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact: int64, or Python's integers where these could overflow."""
    s = np.array(sums, object)
    most = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
    if n * most + max((abs(v) for v in sums), default=0) < 1 << 62:
        return n * x - s.astype(np.int64)
    return n * x.astype(object) - s


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return differences(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of squares of the differences, exact; None beyond a bigint."""
    d = differences(x, n, sums)
    if d.dtype != object and d.size and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
        d = d.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (d * d).sum(1)]


def column_sums(blocks: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and the exact sum of each dimension (high and low halves, so that nothing overflows)."""
    def task(batch: pa.RecordBatch, i: int) -> np.ndarray:
        x = vectors(batch, i, dim)
        return np.concatenate(([len(x)], (x >> 20).sum(0), (x & ((1 << 20) - 1)).sum(0)))

    t = totals(blocks, task, 1 + 2 * dim, "long")
    return int(t[0]), tuple((int(h) << 20) + int(low) for h, low in zip(t[1: 1 + dim], t[1 + dim:]))


def bidiagonalise(blocks: DataFrame, dim: int, n: int, sums: tuple[int, ...], k: int, *, seed: int = SEED,
                  full_steps: int = FULL_STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest singular values of the centred rows and their right singular vectors (dim x k).

    All ``dim`` steps are made up to ``full_steps`` dimensions, which makes the result that of a
    whole factorisation.  With more, steps end where the rests of the wanted components are under
    ``tolerance``; of exactly equal deviations one alone may then come out before the last step.
    """
    rng = np.random.default_rng(seed)
    right, left, through = (np.zeros((dim, 0)) for _ in range(3))  # V, Y (U = X Y), Xᵀ U
    alphas, betas, gram = [], [], np.zeros((0, 0))
    v, beta, greatest = _fresh(right, rng), 0.0, 0.0
    while True:
        j = right.shape[1]
        right = np.column_stack((right, v))
        own_left, own_beta, own_v = left, beta, v

        def task(batch: pa.RecordBatch, i: int) -> np.ndarray:
            x = centred(vectors(batch, i, dim), n, sums)
            u = x @ own_left
            w = x @ own_v - (own_beta * u[:, -1] if j else 0.0)
            last = u.T @ u[:, -1] if j else np.zeros(0)
            return np.concatenate((x.T @ w, u.T @ w, last, [w @ w]))

        t = totals(blocks, task, dim + 2 * j + 1)
        back, inner, last, square = t[:dim], t[dim: dim + j], t[dim + j: dim + 2 * j], t[-1]
        if j:
            gram = np.pad(gram, ((0, 1), (0, 1)))
            gram[-1, :], gram[:, -1] = last, last
        off = 2 * inner - gram @ inner  # both rounds of reorthogonalisation
        alpha = float(np.sqrt(max(0.0, square - 2 * off @ inner + off @ gram @ off)))
        greatest = max(greatest, alpha, beta)
        if alpha <= BREAK * greatest:
            alpha, y, image = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            y = (v - (beta * left[:, -1] if j else 0.0) - left @ off) / alpha
            image = (back - through @ off) / alpha
        left, through = np.column_stack((left, y)), np.column_stack((through, image))
        alphas.append(alpha)
        r = image - alpha * v
        for _ in range(2):
            r = r - right @ (right.T @ r)
        beta = float(np.linalg.norm(r))
        done = right.shape[1] == dim
        b = np.diag(alphas) + np.diag(betas, 1)
        if not done and dim > full_steps and right.shape[1] >= 2 * k:
            p, s, _ = np.linalg.svd(b)
            done = bool((np.abs(beta * p[-1, :k]) <= tolerance * s[0]).all())
        if done:
            _, s, q = np.linalg.svd(b)
            return s[:k], right @ q[:k].T
        if beta <= BREAK * greatest:
            v, beta = _fresh(right, rng), 0.0
        else:
            v = r / beta
        betas.append(beta)


def _fresh(right: np.ndarray, rng) -> np.ndarray:
    """A unit vector at right angles to the columns of ``right``."""
    v = rng.normal(size=right.shape[0])
    for _ in range(3):
        v = v - right @ (right.T @ v)
        v = v / np.linalg.norm(v)
    return v


def fit(blocks: DataFrame, dim: int, k: int = COMPONENTS, **options) -> Whitening:
    """The components of all rows of ``blocks`` (see ``packed``), numbered by falling variance."""
    n, sums = column_sums(blocks, dim)
    values, parts = bidiagonalise(blocks, dim, n, sums, min(k, dim), **options)
    trace = totals(blocks, lambda batch, i: np.array([(centred(vectors(batch, i, dim), n, sums) ** 2).sum()]), 1)[0] / n
    some = values > FLAT * max(values.max(initial=0.0), 1e-150)
    values, parts = values[some], parts[:, some]
    turn = np.sign(parts[np.abs(parts).argmax(0), np.arange(parts.shape[1])]) if parts.size else np.ones(0)
    variances = values ** 2 / n
    return Whitening(n, sums, parts * turn, variances, variances / trace if trace else variances)


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows x components."""
    return centred(x, model.n, model.sums) @ (model.components / np.sqrt(model.variances))


def identity_error(blocks: DataFrame, dim: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k = len(model.variances)

    def task(batch: pa.RecordBatch, i: int) -> np.ndarray:
        z = whitened(vectors(batch, i, dim), model)
        return np.concatenate((z.sum(0), (z.T @ z).ravel()))

    t = totals(blocks, task, k + k * k) / model.n
    cov = t[k:].reshape(k, k) - np.outer(t[:k], t[:k])
    return float(np.abs(cov - np.eye(k)).max())


def whiten(spark: SparkSession, rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, **options) -> DataFrame:
    """One row per usable row and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null, empty or holds null or non-finite entries go.  An entry c becomes
    floor(``scale`` * c) + ``shift`` (products beyond +-2^40 count as that).  The fit is over all
    remaining rows: n rows x with sums S by dimension.  ``deviation`` is the sum of (n*x - S)^2, exact
    (null where a bigint can not hold it); ``whitened`` the row minus the mean on the component, over
    the root of its variance; ``explained`` the variance's share of the trace; ``identity_error`` is
    measured over the whitened rows.  Repeated rows and ids count as often as they stand; null ids stay.
    Where lengths differ, the commonest is whitened (of equally common ones the greatest) and other rows
    go, as they can not be centred with it.  A component without variance can not be whitened and gives no rows, so
    equal rows, one row or an empty table give an empty result.  Other columns are not read.
    """
    v = F.col(f"`{vector_col}`")
    good = rows.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v")).filter(finite(F.col("v")))
    dim = commonest_size(good, "v")
    x = F.transform(whole_numbers(F.col("v"), scale, BOUND), lambda c: c + F.lit(shift).cast("long"))
    blocks = packed(spark, good.filter(F.size("v") == dim).select("vec_id", x.alias("x")), max(dim, 1), "whiten-blocks")
    kind = good.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                           T.StructField("identity_error", T.DoubleType())])
    model = fit(blocks, dim, components, **options) if dim else None
    if model is None or not len(model.variances):
        return spark.createDataFrame([], schema)
    error, k = identity_error(blocks, dim, model), len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = vectors(batch, i, dim)
                ids = batch.column("vec_id")[i].values.take(pa.array(np.repeat(np.arange(len(x)), k)))
                every = lambda values, t: pa.array(np.tile(values, len(x)), t)
                exact = pa.array(deviations(x, model.n, model.sums), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, every(np.arange(1, k + 1), pa.int32()), every(np.full(k, model.n), pa.int64()),
                     exact.take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(whitened(x, model).ravel(), pa.float64()),
                     every(model.explained, pa.float64()), every(np.full(k, error), pa.float64())], schema.names)

    return blocks.select("vec_id", "x").mapInArrow(run, schema)
