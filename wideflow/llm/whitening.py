"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred integer matrix X (vectors by dimensions) is never formed: every
step is one pass over the rows that gives X'u for u = Xv, while the short
vectors v and the bidiagonal entries stay with the driver.  The left vectors u
are as long as the table; they are kept as combinations u_j = X p_j of its
columns, so a pass makes any of them from its row alone, nothing is stored for
a step, and a lost executor costs one pass.  A pass returns the new vector's
product with all earlier left vectors and its length too, so that both sides
are orthogonalised fully without a second pass.  The singular values of the
bidiagonal matrix give the deviations, its right vectors the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideflow.session import release

from .codes import SCALE, usable
from .common import stored

SHIFT = 100_000
#: Steps that are always made (or as many as there are dimensions), and the
#: residual, relative to the largest singular value, at which they may end.
STEPS, TOLERANCE = 64, 1e-13
LONGEST = 2**63 - 1


def integers(rows: DataFrame, dims: int) -> DataFrame:
    """vec_id and x: the integers floor(SCALE * c) + SHIFT of every vector."""
    x = F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))
    return rows.where(F.size("v") == dims).select("vec_id", x.alias("x"))


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def summed(t: DataFrame, of, dims: int, kind: str = "double") -> np.ndarray:
    """Sum over all batches of ``of(matrix)``, an array of a fixed size: one per
    task, then by place, so that the driver gets one number for each place."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                one = of(matrix(batch, dims))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "s"])

    got = t.select("x").mapInArrow(run, f"at long, s {kind}").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(len(got), dtype=np.int64 if kind == "long" else float)
    for r in got:
        out[r["at"]] = r["s"]
    return out


class Centred:
    """The centred rows of ``t``, of which products are taken."""

    def __init__(self, t: DataFrame, dims: int):
        self.t, self.dims = t, dims
        got = summed(t, lambda x: np.append(x.sum(axis=0), len(x)), dims, "long")
        self.sums, self.n = got[:-1], int(got[-1])

    def products(self, p: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For u = X p: X'u, the products of u with X times each column of
        ``earlier``, and u'u."""
        sums, n = self.sums, self.n

        def of(x):
            z = (x * n - sums) / n
            u = z @ p
            return np.concatenate((z.T @ u, (z @ earlier).T @ u, [u @ u]))

        got = summed(self.t, of, self.dims)
        return got[:self.dims], got[self.dims:-1], float(got[-1])


def bidiagonalise(x: Centred, wanted: int, steps: int = STEPS, tolerance: float = TOLERANCE,
                  seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of the centred rows,
    the ``wanted`` largest at least.  Where the Krylov space ends early (equal
    singular values, low rank) a new direction, orthogonal to all before, begins."""
    d = x.dims
    rng = np.random.default_rng(seed)

    def fresh(v):
        """A unit vector orthogonal to the columns of v."""
        w = rng.standard_normal(d)
        for _ in range(3):
            w -= v @ (v.T @ w)
        return w / np.linalg.norm(w)

    v = np.zeros((d, 0))
    p = np.zeros((d, 0))                     # u_j = X p_j
    back = np.zeros((d, 0))                  # X'u_j
    b = np.zeros((d, d))
    w, largest = fresh(v), 0.0
    for k in range(d):
        v = np.column_stack((v, w))
        # u = X v_k - (its part along the u before): the last column of B holds it
        direction = w - p[:, -1] * b[k - 1, k] if k else w
        xtu, along, square = x.products(direction, p)
        # u along the earlier ones, which is rounding only, is taken off as well
        direction = direction - p @ along
        xtu = xtu - back @ along
        if k:
            b[:k, k] += along
        alpha = max(square - float(along @ along), 0.0) ** 0.5
        largest = max(largest, alpha)
        zero = alpha <= 1e-12 * max(largest, 1e-300)
        p = np.column_stack((p, np.zeros(d) if zero else direction / alpha))
        back = np.column_stack((back, np.zeros(d) if zero else xtu / alpha))
        b[k, k] = 0.0 if zero else alpha
        if k + 1 == d:
            break
        w = back[:, -1].copy()
        for _ in range(2):
            w -= v @ (v.T @ w)
        beta = float(np.linalg.norm(w))
        if beta <= 1e-11 * max(largest, 1e-300):
            w, beta = fresh(v), 0.0
        else:
            w /= beta
        left, s, _ = np.linalg.svd(b[:k + 1, :k + 1])
        if k + 1 >= steps and k + 1 >= wanted and beta > 0 and np.all(
                beta * np.abs(left[k, :wanted]) <= tolerance * s[0]):
            break
        b[k, k + 1] = beta
    k = v.shape[1]
    _, s, right = np.linalg.svd(b[:k, :k])
    return s, v @ right.T


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of
    every row of ``vectors`` (vec_id, embedding) whose vector is there and finite.

    The fit list is all these rows.  Components without variance (fewer rows or
    dimensions than ``components``, or copies of one vector only) are left out.
    Rows whose vector has not the length of the smallest vec_id's (NULL last) are
    dropped as malformed.  Repeated rows are rows of their own; other columns are
    not read; an empty table gives an empty result.  A deviation beyond a long is
    NULL.
    """
    rows = usable(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.col("v")).limit(1).collect()
    kind = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double")
    dims = len(first[0]["v"]) if first else 0
    if not dims:
        return vectors.sparkSession.createDataFrame([], kind)
    t = stored(integers(rows, dims))
    x = Centred(t, dims)
    s, v = bidiagonalise(x, min(components, dims))
    s, v = s[:components], v[:, :components]
    live = s > 1e-9 * max(s[0], 1e-300) if s[0] > 0 else s > 0
    s, v = s[live], v[:, live]
    n, sums = x.n, x.sums
    if not len(s):
        return vectors.sparkSession.createDataFrame([], kind)
    to = v / (s / n ** 0.5)                   # projects a centred row and divides by its deviation
    trace = summed(t, lambda x: np.array([(((x * n - sums) / n) ** 2).sum()]), dims)[0]
    share = s ** 2 / trace

    def covariance(x):
        w = ((x * n - sums) / n) @ to
        return np.concatenate(((w.T @ w).ravel(), w.sum(axis=0)))

    got = summed(t, covariance, dims)
    m = len(s)
    mean = got[m * m:] / n
    error = float(np.abs(got[:m * m].reshape(m, m) / n - np.outer(mean, mean) - np.eye(m)).max())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = matrix(batch, dims) * n - sums
            if float(np.abs(wide).max()) ** 2 * dims < 2.0**62:
                deviation = pa.array((wide * wide).sum(axis=1))
            else:
                big = [sum(int(c) ** 2 for c in r) for r in wide]
                deviation = pa.array([b if b <= LONGEST else None for b in big], pa.int64())
            w = (wide / n) @ to
            for i in range(m):
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(np.full(rows, i + 1, np.int32)), pa.array(np.full(rows, n)),
                     deviation, pa.array(w[:, i]), pa.array(np.full(rows, share[i])),
                     pa.array(np.full(rows, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = stored(t.mapInArrow(run, kind))
    release(t)
    return out
