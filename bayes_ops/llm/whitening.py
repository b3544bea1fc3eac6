"""Embedding whitening by spectrum slicing of the exact covariance.

Vectors are scaled to integers x = floor(1024 c) + 100000.  Two passes
gather n, the sums S and, centred at the rounded means, the d x d products, all
in exact integers (one row of partial sums per task, added up in Spark), so n^2 V is known
exactly and reruns agree to the last bit.  The d x d matrix alone comes to the driver.

1. Slicing: an LDL^T factorisation (symmetric pivots of order 1 and 2) of V - s I
   has as many positive pivots as V has eigenvalues above s.  Bisection on these
   counts isolates each leading eigenvalue in an interval of its own.
2. Rayleigh quotient iteration from the middle of the interval converges
   cubically; a quotient that leaves its interval is discarded and the interval is sliced on.
3. Counts just below and just above the eigenvalue certify its number.  Eigenvalues too
   close to be told apart are solved together, as an orthonormal basis of their space.

Defined results: vectors that are null or hold null or non-finite entries are dropped, as are
vectors of another length than the most frequent one (of equally frequent ones, the longest) and
empty ones; x is clamped to +-2^45; rows with a null or repeated vec_id are all kept.  A component
without variance (eigenvalue below d * 2^-52 of the trace) has whitened 0 and stays out of identity_error.
``deviation`` is null where it exceeds a long.  Vectors shorter than ``COMPONENTS`` have as many
components as entries.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayes_ops.llm.common import spill

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
MOST = 1 << 45                 # x is clamped here, so every product of a table fits 38 digits
ROWS = 4096                    # vectors multiplied at once
EXACT = 1 << 20                # entries below it have sums of ROWS products below 2^53, exact as doubles
_PIVOT = (1 + 17 ** 0.5) / 8   # bounds the growth of pivots of order 1 and 2


# --- distributed passes ------------------------------------------------------

def fit_list(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that remain."""
    v = F.col("embedding").cast("array<double>")
    good = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).filter(v.isNotNull() & (F.size(v) > 0) & good)
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (top["d"] if top else 0))


def _integers(batch: pa.RecordBatch, column: int) -> np.ndarray:
    v = batch.column(column)
    c = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    return np.clip(np.floor(c * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def _partial(totals: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([list(range(len(totals)))]), pa.array([totals], pa.list_(pa.decimal128(38, 0)))], names=["at", "total"])


def _added_up(rows: DataFrame, make) -> list[int]:
    """Sums over all tasks of the rows of integers that ``make`` yields."""
    parts = rows.mapInArrow(make, "at array<bigint>, total array<decimal(38,0)>")
    each = parts.select(F.explode(F.arrays_zip("at", "total")).alias("p"))
    return [int(r["t"]) for r in each.groupBy("p.at").agg(F.sum("p.total").alias("t")).orderBy("at").collect()]


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sum of x by dimension."""
    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in it:
            x = _integers(batch, 0)
            if len(x):
                n, total = n + len(x), total + x.astype(object if np.abs(x).max() > 1 << 40 else np.int64).sum(0).astype(object)
        if n:
            yield _partial([n, *total])

    got = _added_up(rows.select("v"), make)
    return (got[0], got[1:]) if got else (0, [])


def products(rows: DataFrame, centre: list[int]) -> tuple[list[int], list[int]]:
    """Exact sums of y and of the upper triangle of y y^T, y = x - ``centre``."""
    d, mid = len(centre), np.array(centre, np.int64)
    upper = np.triu_indices(d)

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross, n = np.zeros(d, object), np.zeros((d, d), object), 0
        for batch in it:
            every = _integers(batch, 0) - mid
            for lo in range(0, len(every), ROWS):
                y = every[lo:lo + ROWS]
                small = np.abs(y).max() < EXACT
                y = y.astype(np.float64 if small else object)
                part = (y.T @ y).astype(np.int64) if small else y.T @ y
                total, cross, n = total + y.sum(0).astype(np.int64 if small else object), cross + part, n + len(y)
        if n:
            yield _partial([*(int(t) for t in total), *(int(t) for t in cross[upper])])

    got = _added_up(rows.select("v"), make)
    return got[:d], got[d:]


def covariance(n: int, total: list[int], upper: list[int]) -> np.ndarray:
    """V from sums about a centre: (n * products - sums sums^T) / n^2, each entry rounded once."""
    d = len(total)
    v, at = np.zeros((d, d)), iter(upper)
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = float(Fraction(n * next(at) - total[i] * total[j], n * n))
    return v


# --- eigenvalues of one small symmetric matrix ---------------------------------

def inertia(a: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix: positive pivots of its LDL^T factorisation."""
    a, positive, k = a.copy(), 0, len(a)
    while k:
        m = a[:k, :k]
        diagonal = np.abs(np.diagonal(m))
        r = int(np.argmax(diagonal))
        off = np.abs(np.tril(m, -1))
        p, q = divmod(int(np.argmax(off)), k)
        if diagonal[r] == 0 and off[p, q] == 0:
            break
        if diagonal[r] >= _PIVOT * off[p, q]:        # a pivot of order 1, moved to the end
            for x in (m, m.T):
                x[[r, k - 1]] = x[[k - 1, r]]
            positive += m[k - 1, k - 1] > 0
            m[:k - 1, :k - 1] -= np.outer(m[:k - 1, k - 1], m[:k - 1, k - 1]) / m[k - 1, k - 1]
            k -= 1
        else:                                        # a pivot of order 2: one eigenvalue of either sign
            for x in (m, m.T):
                x[[p, k - 1]] = x[[k - 1, p]]
                q_now = p if q == k - 1 else q
                x[[q_now, k - 2]] = x[[k - 2, q_now]]
            e = m[k - 2:k, k - 2:k].copy()
            positive += 1 if np.linalg.det(e) < 0 else 2 * (e[0, 0] > 0)
            c = m[:k - 2, k - 2:k]
            m[:k - 2, :k - 2] -= c @ np.linalg.solve(e, c.T)
            k -= 2
    return int(positive)


def above(v: np.ndarray, s: float) -> int:
    """How many eigenvalues of ``v`` exceed ``s``."""
    return inertia(v - s * np.eye(len(v)))


def _quotient_iteration(v: np.ndarray, s: float, steps: int = 12) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the shift ``s``."""
    d, scale = len(v), np.abs(v).sum(1).max()
    x = np.random.default_rng(0).standard_normal(d)
    for step in range(steps):
        try:
            y = np.linalg.solve(v - s * np.eye(d), x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(v - (s + scale * 2.0 ** -52) * np.eye(d), x)
        x = y / np.linalg.norm(y)
        if step:                                     # the first two solves keep the interval's middle
            s = float(x @ v @ x)
            if np.linalg.norm(v @ x - s * x) <= 4 * scale * 2.0 ** -52:
                break
    return s, x


def leading(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest eigenvalues of ``v``, falling, and unit eigenvectors as columns."""
    d = len(v)
    count = min(count, d)
    reach = float(np.abs(v).sum(1).max())
    if reach == 0:
        return np.zeros(count), np.eye(d)[:, :count]
    fine = reach * d * 2.0 ** -52
    values, vectors, j = [], [], 1
    lo_start, hi_start = -reach - fine, reach + fine
    while j <= count:
        lo, hi, n_lo, n_hi = lo_start, hi_start, d, 0
        while True:
            mid = (lo + hi) / 2
            n = above(v, mid)
            lo, hi, n_lo, n_hi = (mid, hi, n, n_hi) if n >= j else (lo, mid, n_lo, n)
            alone = n_lo == j and n_hi == j - 1
            if alone:
                s, x = _quotient_iteration(v, (lo + hi) / 2)
                near = max(fine, (hi - lo) * 2.0 ** -20)
                if lo < s <= hi and above(v, s - near) >= j and above(v, s + near) < j:
                    values.append(s)
                    vectors.append(x)
                    j += 1
                    break
            if hi - lo <= fine:                      # eigenvalues j to n_lo agree to rounding: one space
                many = max(n_lo - j + 1, 1)
                space = np.random.default_rng(j).standard_normal((d, many))
                for _ in range(4):
                    space = np.linalg.qr(np.linalg.solve(v - (hi + fine) * np.eye(d), space))[0]
                    if vectors:
                        before = np.array(vectors).T
                        space = np.linalg.qr(space - before @ (before.T @ space))[0]
                values += [float(s) for s in np.sort(np.einsum("ij,ij->j", space, v @ space))[::-1]]
                order = np.argsort(-np.einsum("ij,ij->j", space, v @ space))
                vectors += list(space[:, order].T)
                j += many
                break
    u = np.array(vectors).T
    q, r = np.linalg.qr(u)
    return np.array(values[:count]), (q * np.sign(np.diagonal(r)))[:, :count]


# --- the operator ---------------------------------------------------------------

def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = spill(fit_list(vectors), "vectors")
    n, total = sums(rows)
    shape = f"vec_id {kind}, deviation bigint, w array<double>"
    if not n:
        wide, values, trace, error = vectors.sparkSession.createDataFrame([], shape), np.zeros(1), 0.0, 0.0
    else:
        centre = [(2 * t + n) // (2 * n) for t in total]
        about, upper = products(rows, centre)
        v = covariance(n, about, upper)
        trace = float(np.trace(v))
        values, axes = leading(v, components)
        has = values > max(trace, 0.0) * len(v) * 2.0 ** -52
        scaled = axes / np.sqrt(np.where(has, values, 1.0)) * has
        mid, rest = np.array(centre, np.int64), np.array(about, object)

        def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                y = _integers(batch, 1) - mid
                # n x - S = n y - (sum of y), exact in longs or else in Python's integers
                small = len(y) == 0 or n * float(np.abs(y).max() + 1) * len(mid) ** 0.5 < 2.0 ** 30
                z = (y if small else y.astype(object)) * n - (rest.astype(np.int64) if small else rest)
                far = (z * z).sum(1) if len(z) else np.zeros(0, np.int64)
                w = (z / n if small else (z / n).astype(np.float64)) @ scaled
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([int(f) if f < 1 << 63 else None for f in far], pa.int64()),
                     pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())],
                    names=["vec_id", "deviation", "w"])

        wide = spill(rows.mapInArrow(make, shape), "whitened")
        error = _identity_error(wide, np.flatnonzero(has))
    explained = F.array(*[F.lit(float(e / trace) if trace > 0 else 0.0) for e in values])
    return wide.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))


def _identity_error(wide: DataFrame, kept: np.ndarray) -> float:
    """Largest entry of the whitened components' covariance minus the identity, from the whitened rows."""
    if not len(kept):
        return 0.0
    each = [F.col("w")[int(k)].alias(f"w{k}") for k in kept]
    flat = wide.select(*each)
    means = flat.agg(*[F.avg(f"w{k}").alias(f"m{k}") for k in kept]).first()
    y = flat.select(*[(F.col(f"w{k}") - F.lit(means[f"m{k}"])).alias(f"y{k}") for k in kept])
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    got = y.agg(*[F.avg(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
