r"""Whitening of embeddings by shifted Cholesky QR.

Components become integers, x = floor(scale * c) + shift, so that the number n of
vectors and the sums S of each dimension are exact, and a centred entry is one
division, (n * x - S) / n. Every pass is a scan of the vectors: a task centres its
rows, solves them through the triangular factors found so far, and adds their
products to a d x d matrix of its own; Spark sums the tasks' matrices entry by
entry. The driver takes the Cholesky factor of the sum, in the first pass and
while the matrix is near singular with a shift on the diagonal that exceeds the
rounding of the sums, and composes R = R_k ... R_1. Passes go on until the rows
are orthogonal but for directions without variance; the little that the last
matrix differs from the identity is put into R too. With R = U diag(s) W' the
columns of W are the covariance's eigenvectors and s^2 / n its eigenvalues. Only
d x d matrices reach the driver. A last pass over the whitened rows gives the
distance of their covariance from the identity.

Read a table, not a plan that gives other rows each time: the vectors are read
once for the sums, once for each pass (two as a rule, more if the covariance is
near singular), once for its check and once for the result.

Edge cases: vectors that are null or hold a null, NaN or infinity are dropped; a
null ``vec_id`` is carried through, and repeated rows and ids count each on their
own; shorter vectors count as padded with zeros; x saturates at 2^62 either way
and a deviation at 2^63 - 1; components without variance (below 1e-24 of the
largest) cannot be whitened and are not returned, so vectors that are all alike
give no row; of equal eigenvalues any basis is taken, the same for all rows; an
empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
#: Entries that one NumPy pass takes at once.
AT_ONCE = 1 << 21
#: x saturates here, so that it stays a 64-bit integer.
LARGEST = 1 << 62
#: A direction whose singular value is below this share of the largest has no variance but that of rounding.
NO_VARIANCE = 1e-12
#: How near to 1 all eigenvalues of the rows' products are when the passes end; what is left goes into R.
ORTHOGONAL = 1e-6


class Centre(NamedTuple):
    """What centring needs: vectors, dimensions, sums of each dimension (Python integers), the largest |x|, and how x is made."""

    n: int
    dim: int
    sums: list[int]
    largest: int
    scale: int
    shift: int


def integers(batch: pa.RecordBatch, scale: int, shift: int, dim: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors of the batch's valid rows, some rows at a time, padded to ``dim`` or the longest of them."""
    lists = batch.column("embedding")
    entries = lists.flatten()  # without what stands below null rows
    lens = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    value = entries.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    first = np.cumsum(lens) - lens
    wrong = np.r_[0, np.cumsum(~np.isfinite(value))]
    rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (wrong[first + lens] == wrong[first]))
    at_once = max(1, AT_ONCE // max(1, dim or int(lens.max(initial=1))))
    for s in range(0, len(rows), at_once):
        own = rows[s : s + at_once]
        wide = dim or max(1, int(lens[own].max(initial=1)))
        c = np.zeros((len(own), wide))
        if (lens[own] == wide).all() and len(own):
            c[:] = value[(first[own, None] + np.arange(wide))]
        else:
            for i, k in enumerate(own):
                c[i, : lens[k]] = value[first[k] : first[k] + lens[k]]
        x = np.floor(scale * c) + shift
        yield batch.column("vec_id").take(pa.array(own)), np.clip(x, -float(LARGEST), float(LARGEST)).astype(np.int64)


def _frame(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def centre(vectors: DataFrame, scale: int, shift: int) -> Centre | None:
    """Exact sums over all valid vectors; nothing if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, largest, longest = 0, np.zeros(0, object), 0, 0
        for batch in batches:
            for _, x in integers(batch, scale, shift):
                n, longest = n + len(x), max(longest, x.shape[1])
                largest = max(largest, int(x.max(initial=0)), -int(x.min(initial=0)))
                # Sums of a part fit in 64 bits unless entries are huge.
                part = x.sum(0) if int(np.abs(x.astype(float)).max(initial=0)) < 2**62 // max(1, len(x)) else x.astype(object).sum(0)
                # Dimensions that a batch lacks stand for entries of zero.
                wide = max(len(sums), len(part))
                before = n - len(x)
                sums = np.r_[sums, np.full(wide - len(sums), before * shift, object)] + np.r_[part.astype(object), np.full(wide - len(part), len(x) * shift, object)]
        yield pa.RecordBatch.from_pydict(
            {
                "i": pa.array([-1, *range(len(sums))], pa.int32()),
                "total": pa.array([str(n), *map(str, sums)], pa.string()),
                "n": pa.array([n] * (len(sums) + 1), pa.int64()),
                "largest": pa.array([largest] * (len(sums) + 1), pa.int64()),
            }
        )

    parts = vectors.select("vec_id", "embedding").mapInArrow(run, "i int, total string, n bigint, largest bigint")
    parts = parts.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.max("largest").alias("largest")).collect()  # one row per dimension
    by = {r.i: r for r in parts}
    n = int(by[-1].total) if -1 in by else 0
    if not n:
        return None
    dim = max(by) + 1
    # Tasks without the dimension have entries of zero there.
    sums = [int(by[i].total) + (n - by[i].n) * shift for i in range(dim)]
    return Centre(n, dim, sums, max(r.largest for r in parts), scale, shift)


def numerators(x: np.ndarray, c: Centre) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they fit, else Python's."""
    if 2 * c.n * max(c.largest, 1) < 1 << 63:
        return x * c.n - np.array(c.sums, np.int64)
    return x.astype(object) * c.n - np.array(c.sums, object)


def centred(x: np.ndarray, c: Centre) -> np.ndarray:
    return (numerators(x, c) / c.n).astype(float)


def deviations(x: np.ndarray, c: Centre) -> np.ndarray:
    """The sum of squares of n * x - S of each row, exact, at most 2^63 - 1."""
    d = numerators(x, c)
    if d.dtype != object:
        bound = float(np.abs(d.astype(float)).max(initial=0))
        if bound * bound * d.shape[1] < 2.0**62:
            return (d * d).sum(1)
    return np.array([min(sum(int(v) ** 2 for v in row), (1 << 63) - 1) for row in d], np.int64)


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows R_1^-1 ... R_k^-1, by one triangular solve after the other."""
    for r in factors:
        out = np.empty_like(rows)
        # Columns in order, in strips: what is left of a strip after the strips before it, times the inverse of its own triangle.
        for a in range(0, r.shape[0], 32):
            b = min(a + 32, r.shape[0])
            left = rows[:, a:b] - out[:, :a] @ r[:a, a:b]
            for j in range(a, b):
                out[:, j] = (left[:, j - a] - out[:, a:j] @ r[a:j, j]) / r[j, j]
        rows = out
    return rows


def products(vectors: DataFrame, c: Centre, of: Callable[[np.ndarray], np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums, and the dim x dim matrix of products, of the columns that ``of`` makes of centred rows."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((dim, dim)), np.zeros(dim)
        for batch in batches:
            for _, x in integers(batch, c.scale, c.shift, c.dim):
                m = of(centred(x, c))
                total += m.T @ m
                sums += m.sum(0)
        yield _frame(i=np.arange(dim + len(upper[0])), x=np.r_[sums, total[upper]])

    parts = vectors.select("vec_id", "embedding").mapInArrow(run, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(dim + len(upper[0]))
    flat[parts["i"]] = parts["x"]
    out = np.zeros((dim, dim))
    out[upper] = flat[dim:]
    return flat[:dim], out + np.triu(out, 1).T


def orthogonalised(gram_of: Callable[[list[np.ndarray]], np.ndarray], dim: int) -> np.ndarray:
    """R of the rows' QR factorisation, from passes that give the products of rows solved through given factors."""
    factors: list[np.ndarray] = []
    r = np.eye(dim)
    while True:
        g = gram_of(factors)
        values, basis = np.linalg.eigh(g)
        top = max(values[-1], 0.0)
        if top == 0.0:
            return np.zeros((dim, dim))
        if factors:
            folded = np.sqrt(np.maximum(values, 0.0))[:, None] * (basis.T @ r)
            s = np.linalg.svd(folded, compute_uv=False)
            if (np.abs(values - 1) <= ORTHOGONAL).sum() >= (s > NO_VARIANCE * s[0]).sum():
                return folded
        # The shift of the first pass, and of others whose matrix is near singular: above what rounding may take away.
        # 11 (m d + d (d + 1)) u |G|, with m the rows that are summed in one chain of additions.
        shift = 11 * (AT_ONCE + dim * (dim + 1)) * np.finfo(float).eps / 2 * top if not factors or values[0] < 0.5 else 0.0
        factor = np.linalg.cholesky(g + shift * np.eye(dim)).T
        factors.append(factor)
        r = factor @ r


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Rows of ``SCHEMA``: every valid row of ``vectors`` (vec_id, embedding) on its first principal components, whitened.

    ``explained`` is the component's share of the variance, ``deviation`` the row's
    squared distance from the mean times n^2.
    """
    spark = vectors.sparkSession
    c = centre(vectors, scale, shift)
    if c is None:
        return spark.createDataFrame([], SCHEMA)
    r = orthogonalised(lambda factors: products(vectors, c, lambda m: solved(m, factors), c.dim)[1], c.dim)
    _, s, w = np.linalg.svd(r)
    count = min(components, int((s > NO_VARIANCE * s[0]).sum()))
    if not count:
        return spark.createDataFrame([], SCHEMA)
    axes, values = w[:count].T, s**2 / c.n
    spread, explained = np.sqrt(values[:count]), values[:count] / values.sum()
    sums, second = products(vectors, c, lambda m: m @ axes / spread, count)
    mean = sums / c.n
    error = float(np.abs(second / c.n - np.outer(mean, mean) - np.eye(count)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in integers(batch, scale, shift, c.dim):
                n = len(x)
                each = np.repeat(np.arange(n), count)
                yield _frame(
                    vec_id=ids.cast(pa.int64()).take(pa.array(each)),
                    component=np.tile(np.arange(1, count + 1, dtype=np.int32), n),
                    n=np.full(n * count, c.n, np.int64),
                    deviation=deviations(x, c)[each],
                    whitened=(centred(x, c) @ axes / spread).ravel(),
                    explained=np.tile(explained, n),
                    identity_error=np.full(n * count, error),
                )

    return vectors.select("vec_id", "embedding").mapInArrow(run, SCHEMA)
