"""Whitening of vectors along the leading components of their covariance.

Spark sums the covariance of the distinct vectors. Its components are found by spectral divide and
conquer: the polar decomposition of the shifted matrix, by dynamically weighted Halley iterations
(QDWH), gives the projector onto all components above the shift; both invariant subspaces are split
in the same way until a component is left alone. The projection goes to the tasks by broadcast.

What reaches the driver is the covariance, whose size is set by the number of dimensions, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covote.llm.common import kept

SCALE = 256
COMPONENTS = 4
EPS = np.finfo(float).eps
LONG = 1 << 63


def valid(vector: Column) -> Column:
    """Not null and all entries finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def scaled(vector: Column) -> Column:
    """Whole numbers of 1/256."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


# the matrix part, on d x d matrices


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix: its matrix sign, where no eigenvalue is zero."""
    d = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low = EPS  # below the least singular value, as far as doubles can tell
    for _ in range(30):
        l2 = low * low
        s = np.cbrt(4 * (1 - l2) / (l2 * l2)) if low < 1 else 0.0
        root = np.sqrt(1 + s)
        wa = root + np.sqrt(max(8 - 4 * s + 8 * (2 - l2) / (l2 * root), 0.0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(d)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:d] @ q[d:].T)
        new = (new + new.T) / 2
        low = min(low * (wa + wb * l2) / (1 + wc * l2), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if moved <= 10 * EPS * np.sqrt(d) or (low > 1 - 10 * EPS and moved <= np.cbrt(EPS) ** 2):
            break
    return x


def _split(a: np.ndarray, shift: float, seed: int) -> tuple[np.ndarray, int]:
    """An orthogonal basis whose first k columns span the components above ``shift``."""
    d = len(a)
    projector = (polar(a - shift * np.eye(d)) + np.eye(d)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < d:
        return np.eye(d), 0
    draw = np.random.default_rng(seed)
    basis = draw.standard_normal((d, d))
    for _ in range(2):  # the second pass takes out what rounding left of the other subspace
        basis = np.hstack([projector @ basis[:, :k], basis[:, k:] - projector @ basis[:, k:]])
        basis, _ = np.linalg.qr(basis)
    return basis, k


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    The shift is the median of the diagonal or, where all eigenvalues are on one side of that, their mean,
    which always parts them unless they are equal: then any basis will do.
    """
    size = np.linalg.norm(a)
    vectors = np.empty_like(a)
    left = [(a, np.eye(len(a)), 0)]
    while left:
        block, basis, at = left.pop()
        d = len(block)
        mean = np.trace(block) / d if d else 0.0
        if d <= 1 or np.linalg.norm(block - mean * np.eye(d)) <= d * EPS * size:
            vectors[:, at : at + d] = basis
            continue
        for shift in (float(np.median(np.diag(block))), mean):
            turn, k = _split(block, shift, d)
            if k:
                break
        if not k:  # no doubles lie between them
            vectors[:, at : at + d] = basis
            continue
        turned = turn.T @ block @ turn
        turned = (turned + turned.T) / 2
        left.append((turned[:k, :k], basis @ turn[:, :k], at))
        left.append((turned[k:, k:], basis @ turn[:, k:], at + k))
    vectors = _refined(a, _refined(a, vectors))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(a))])
    return values, vectors * np.where(signs == 0, 1, signs)


def _refined(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One first-order correction of approximate eigenvectors; close ones are only made orthogonal."""
    r = np.eye(len(a)) - v.T @ v
    s = v.T @ a @ v
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= 1e6 * EPS * np.linalg.norm(a)
    fix = np.where(near, r / 2, (s + r * values[None, :]) / np.where(near, 1.0, gap))
    v = v + v @ fix
    for _ in range(2):
        v = v + v @ (np.eye(len(a)) - v.T @ v) / 2
    return v


# the Spark part


@dataclass(frozen=True)
class Whitener:
    """What is known of the fit list: ``n`` vectors with the sums ``sums``, components and their shares.

    projection: dimensions x components; a centred vector times it is whitened.
    """

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: np.ndarray


def _stacked(batches: Iterator, name: str, d: int) -> Iterator[np.ndarray]:
    """Vectors of Arrow batches as the rows of matrices, filled with zeros to ``d`` columns."""
    for batch in batches:
        column = batch.column(name)
        lengths = np.asarray(column.value_lengths())
        values = np.asarray(column.flatten())
        out = np.zeros((len(lengths), d), np.int64)
        out[np.arange(d)[None, :] < lengths[:, None]] = values
        yield out


def fit(vectors: DataFrame, count: int = COMPONENTS) -> tuple[Whitener, DataFrame]:
    """The whitener of the distinct vectors ``x``, and these."""
    fit_list = kept(vectors.select("x").distinct(), "fit-list")
    shortest, d = fit_list.agg(F.min(F.size("x")), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if shortest != d:  # vectors that differ by zeros at their ends are equal
        filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
        fit_list = kept(fit_list.select(filled.alias("x")).distinct(), "fit-list")
    n = fit_list.count()
    if n == 0 or d == 0:
        return Whitener(n, [0] * d, np.zeros((d, 0)), np.zeros(0)), fit_list
    each = fit_list.select(F.posexplode("x").alias("k", "x"))
    sums = [0] * d
    # one row a dimension
    for k, total in each.groupBy("k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total")).collect():
        sums[k] = int(total)
    mean = np.array([float(s) / n for s in sums])

    def products(batches):
        total = np.zeros((d, d))
        for x in _stacked(batches, "x", d):
            centred = x - mean
            total += centred.T @ centred
        yield from _rows(total)

    covariance = _added(fit_list.mapInArrow(products, MATRIX), d) / n
    values, axes = components(covariance)
    trace = float(np.trace(covariance))
    use = [k for k in range(min(count, d)) if values[k] > 1e-12 * trace > 0]
    projection = axes[:, use] / np.sqrt(values[use])
    return Whitener(n, sums, projection, values[use] / trace if use else np.zeros(0)), fit_list


MATRIX = "i int, row array<double>"


def _rows(matrix: np.ndarray):
    import pyarrow as pa

    yield pa.RecordBatch.from_pydict(
        {"i": pa.array(np.arange(len(matrix), dtype=np.int32)), "row": pa.array(list(matrix), pa.list_(pa.float64()))}
    )


def _added(parts: DataFrame, d: int) -> np.ndarray:
    """The sum of the partial matrices of all tasks, row by row and entry by entry on the executors."""
    entries = parts.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((d, d))
    for i, j, value in entries.collect():
        out[i, j] = value
    return (out + out.T) / 2


def identity_error(whitener: Whitener, fit_list: DataFrame) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    d, c = whitener.projection.shape
    if c == 0:
        return 0.0
    mean = np.array([float(s) / whitener.n for s in whitener.sums])
    projection = whitener.projection

    def products(batches):
        total = np.zeros((c + 1, c + 1))  # the last row and column: sums, for the mean
        for x in _stacked(batches, "x", d):
            white = np.c_[(x - mean) @ projection, np.ones(len(x))]
            total += white.T @ white
        yield from _rows(total)

    total = _added(fit_list.mapInArrow(products, MATRIX), c + 1) / whitener.n
    covariance = total[:c, :c] - np.outer(total[:c, c], total[:c, c])
    return float(np.abs(covariance - np.eye(c)).max())


def whitened(embeddings: DataFrame, count: int = COMPONENTS, *, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each valid row and component up to ``count``.

    Vectors that are null or hold a null or non-finite entry are left out. Shorter vectors than the longest
    one, empty ones too, count as having zeros at their ends. Equal vectors are fitted once and returned for
    every row; rows of one id, or none, are rows of their own. Components without variance (all vectors
    equal, fewer distinct vectors or dimensions than components) are not returned, so one vector, or none,
    gives no rows. ``deviation`` is exact, and null beyond a BIGINT. Other columns are not looked at.
    """
    import pyarrow as pa

    rows = embeddings.where(valid(F.col(vector))).select(F.col(id_).cast("long").alias("id"), scaled(F.col(vector)).alias("x"))
    whitener, fit_list = fit(rows, count)
    d, c = whitener.projection.shape
    error = identity_error(whitener, fit_list)
    shared = rows.sparkSession.sparkContext.broadcast(whitener)

    def project(batches):
        w = shared.value
        n, sums = w.n, w.sums
        mean = np.array([float(s) / n for s in sums])
        most = max([1, *map(abs, sums)])
        for batch in batches:
            (x,) = _stacked([batch], "x", d)
            if n * max(1, int(np.abs(x).max(initial=0))) + most < 1 << 62 and d * (n * int(np.abs(x).max(initial=0)) + most) ** 2 < LONG:
                far = ((n * x - np.array(sums, np.int64)) ** 2).sum(1)
                deviation = pa.array(far, pa.int64())
            else:  # beyond what numpy can hold
                far = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
                deviation = pa.array([v if v < LONG else None for v in far], pa.int64())
            white = (x - mean) @ w.projection
            ids = batch.column("id")
            for k in range(c):
                size = len(x)
                yield pa.RecordBatch.from_pydict(
                    {
                        id_: ids,
                        "component": pa.array(np.full(size, k + 1, np.int32)),
                        "n": pa.array(np.full(size, n, np.int64)),
                        "deviation": deviation,
                        "whitened": pa.array(white[:, k]),
                        "explained": pa.array(np.full(size, w.explained[k])),
                        "identity_error": pa.array(np.full(size, error)),
                    }
                )

    return rows.mapInArrow(
        project,
        f"{id_} long, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
