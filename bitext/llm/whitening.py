"""Embedding whitening: the covariance by polarisation, from exact integer sums of squares.

For every dimension i and every sum of two dimensions i + j the squares of the centred values are summed; then
cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. All sums are whole numbers, so they do not depend on how rows are dealt
out, and the driver gets one number for each dimension and pair of dimensions, from which it assembles the matrix.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Steps of a unit that entries are rounded down to.
SCALE = 256
#: Rows whose squares are added at a time, and the size of entries up to which they fit 64 bits.
ROWS, SMALL = 4096, 1 << 24
#: Bits of a limb: sums of any size travel as several longs.
LIMB = 31
#: A component with less than this share of the largest eigenvalue is rounding noise.
NOISE = 1e-12


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, x`` (array of longs, ``floor(scale * c)``) of the rows whose vector has neither nulls nor non-finite
    entries; entries beyond a long are cut to its range."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrices(batch: pa.RecordBatch, dims: int | None = None):
    """The vectors of a batch as matrices of at most ``ROWS`` rows and ``dims`` columns (else as many as the longest
    has); shorter vectors are filled up with zeros."""
    column = batch.column("x")
    at, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
    for k in range(0, batch.num_rows, ROWS):
        own = at[k : min(k + ROWS, batch.num_rows) + 1]
        lengths = np.diff(own)
        m = np.zeros((len(lengths), lengths.max() if dims is None else dims), np.int64)
        m[np.arange(m.shape[1]) < lengths[:, None]] = flat[own[0] : own[-1]]
        yield k, m


def _exact(m: np.ndarray) -> np.ndarray:
    """``m`` so that sums of its squares do not overflow: as it is if its entries are small, else of Python ints."""
    return m if not m.size or int(np.abs(m).max()) < SMALL and int(m.min()) > -SMALL else m.astype(object)


class _Sums:
    """Whole-number sums by key (0, 1, ..), as limbs that Spark can add up without overflow."""

    def __init__(self):
        self.low, self.high = np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, values: np.ndarray, first: int = 0) -> None:
        size = max(len(self.low), first + len(values))
        if size > len(self.low):
            self.low = np.append(self.low, np.zeros(size - len(self.low), np.int64))
            self.high = np.append(self.high, np.zeros(size - len(self.high), object))
        own = slice(first, first + len(values))
        self.low[own] += (values & ((1 << LIMB) - 1)).astype(np.int64)
        self.high[own] += values >> LIMB

    def batch(self, empty: bool = False) -> pa.RecordBatch:
        rows = []
        for key, (low, high) in enumerate(zip(self.low.tolist(), self.high.tolist())):
            value, limb = low + (int(high) << LIMB), 0
            while not -(1 << LIMB) <= value < 1 << LIMB:
                rows.append((key, limb, value & ((1 << LIMB) - 1)))
                value, limb = value >> LIMB, limb + 1
            rows.append((key, limb, value))
        keys, limbs, values = zip(*rows) if rows else ((), (), ())
        return pa.record_batch([pa.array(keys, pa.int32()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())], ["key", "limb", "value"])


def _summed(rows: DataFrame, task) -> dict[int, int]:
    """The sums that ``task(matrix, sums)`` adds up over all vectors of ``rows(x)``, by key."""

    def run(batches):
        sums = _Sums()
        for batch in batches:
            for _, m in matrices(batch):
                task(m, sums)
        yield sums.batch()

    limbs = rows.select("x").mapInArrow(run, "key int, limb int, value long").groupBy("key", "limb").agg(F.sum("value").alias("value"))
    out: dict[int, int] = {}
    for r in limbs.collect():  # a few rows for each dimension, or pair of dimensions
        out[r.key] = out.get(r.key, 0) + (r.value << LIMB * r.limb)
    return out


def moments(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors ``fit(x)`` has, and their sum in each dimension."""

    def add(m: np.ndarray, sums: _Sums) -> None:
        sums.add(np.array([len(m)], np.int64))
        small = _exact(m)
        sums.add(small.sum(axis=0), 1)

    found = _summed(fit, add)
    return found.pop(0, 0), [found[k] for k in sorted(found)]


def covariance(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance matrix of ``fit(x)`` (divisor n), each entry rounded once.

    Values are centred at the whole number below their mean, c = floor(S / n), before they are squared; what the mean
    has beyond it, r / n with r = S - n * c, is taken off exactly: the sum of (n * x - S) ** 2 is n * n times the sum of
    (x - c) ** 2, less n * r * r, and likewise for sums of two dimensions."""
    d = len(total)
    centre = [s // n for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    c = np.array(centre, np.int64)

    def add(m: np.ndarray, sums: _Sums) -> None:
        m = np.concatenate([m, np.zeros((len(m), d - m.shape[1]), np.int64)], axis=1)
        wide = bool(m.size) and max(int(m.max()), -int(m.min()), int(np.abs(c).max())) >= 1 << 61
        m = m.astype(object) - c.astype(object) if wide else _exact(m - c)
        first = 0
        for i in range(d):  # dimension i, then its sums with all later ones
            own = m[:, i:].copy()
            own[:, 1:] += m[:, i : i + 1]
            sums.add((own * own).sum(axis=0) if own.dtype == object else np.einsum("ij,ij->j", own, own), first)
            first += d - i

    squares = _summed(fit, add)
    if not d:
        return np.zeros((0, 0))
    spread = iter(squares[k] for k in sorted(squares))
    sums = {}
    for i in range(d):
        for j in range(i, d):
            r = rest[i] if i == j else rest[i] + rest[j]
            sums[i, j] = n * n * next(spread) - n * r * r
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            exact = sums[i, i] if i == j else (sums[i, j] - sums[i, i] - sums[j, j]) // 2
            v[i, j] = v[j, i] = exact / n**3  # whole numbers: one rounding
    return v


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of ``v`` (falling), and their unit eigenvectors as rows. An eigenvector's largest entry
    (the first of equals) is positive. Eigenvalues that are rounding noise are 0."""
    e, u = np.linalg.eigh(v) if len(v) else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-e, kind="stable")[:most]
    e, u = e[order], u[:, order].T
    e = np.where(e > NOISE * max(e[0] if len(e) else 0.0, 0.0), e, 0.0)
    for row in u:
        row *= np.sign(row[np.argmax(np.abs(row))]) or 1.0
    return e, u


def whiten(vectors: DataFrame, most: int = 4, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row of ``vectors(vec_id,
    embedding)`` and each of the first ``most`` principal components of the distinct quantised vectors.

    ``deviation`` (decimal(38, 0), null beyond it) is the exact sum over dimensions of (n * x - S) ** 2; ``whitened`` is
    x less the mean, projected on the component, over the root of its eigenvalue; ``explained`` the component's share of
    the variance; ``identity_error`` the largest absolute entry of the whitened distinct vectors' covariance, measured
    in a pass over them, less the identity.

    Rows whose vector is null or has null or non-finite entries are left out; rows with a null vec_id stay, repeated
    rows are returned each but count once in the fit; a vector that is shorter than the longest counts as 0 in the
    missing dimensions; there are no more components than dimensions. Without any variance in a component its
    ``whitened`` is null, without any at all ``explained`` is null, and where nothing can be whitened
    ``identity_error`` is null. An empty table gives no rows. Other columns are ignored. The matrix is the only thing
    that the driver gets, so memory there follows the square of the dimensions, not the rows."""
    rows = quantised(vectors, scale)
    fit = saved(rows.select("x").distinct(), "fit-list")
    n, total = moments(fit)
    d = len(total)
    v = covariance(fit, n, total)
    e, u = components(v, most)
    whole = float(np.trace(v))
    centre = np.array([s // n for s in total], np.int64)
    rest = [s - n * (s // n) for s in total]
    low, high = (np.array([r >> LIMB * k & ((1 << LIMB) - 1) for r in rest], np.int64) for k in (0, 1))
    part = np.array([r / n for r in rest])
    own = np.flatnonzero(e > 0)
    divide = np.sqrt(np.where(e > 0, e, 1.0))

    def project(m: np.ndarray) -> np.ndarray:
        return ((m.astype(np.float64) - centre) - part) @ u.T / divide

    def spread(batches):
        total = np.zeros((len(own), len(own) + 1))
        for batch in batches:
            for _, m in matrices(batch, d):
                w = project(m)[:, own]
                total[:, :-1] += w.T @ w
                total[:, -1] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    error = None
    if len(own):
        found = np.zeros((len(own), len(own) + 1))
        for r in fit.mapInArrow(spread, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            found[r.i, r.j] = r.v / n
        mean = found[:, -1]
        error = float(np.abs(found[:, :-1] - np.outer(mean, mean) - np.eye(len(own))).max())
    largest = 10**38

    def emit(batches):
        for batch in batches:
            for k, m in matrices(batch, d):
                w = project(m)
                wide = bool(m.size) and max(int(m.max()), -int(m.min())) >= 1 << 61
                near = m.astype(object) - centre.astype(object) if wide else _exact(m - centre)
                square = (near * near).sum(axis=1).astype(object)
                if near.dtype != object and int(np.abs(near).max(initial=0)) * d < 1 << 32:  # so that no limb's sum overflows
                    cross = (near @ low).astype(object) + ((near @ high).astype(object) << LIMB)
                else:
                    cross = (near.astype(object) * np.array(rest, object)).sum(axis=1)
                deviation = n * n * square - 2 * n * cross + sum(r * r for r in rest)
                deviation = [Decimal(x) if x < largest else None for x in deviation.tolist()]
                count = len(e)
                ids = batch.column("vec_id").slice(k, len(m)).take(pa.array(np.repeat(np.arange(len(m)), count)))
                yield pa.record_batch(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(m))),
                        pa.array(np.full(len(m) * count, n, np.int64)),
                        pa.array(np.repeat(np.array(deviation, object), count), pa.decimal128(38, 0)),
                        pa.array(w.ravel(), mask=np.tile(e <= 0, len(m))),
                        pa.array(np.tile(e / whole if whole > 0 else np.zeros(count), len(m)), mask=np.full(len(m) * count, not whole > 0)),
                        pa.array([error] * (len(m) * count), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(emit, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
