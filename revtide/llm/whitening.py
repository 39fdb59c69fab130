"""Whitening of vectors by singular values of the centred rows, found by quotient differences.

1. Sums of all rows give the exact mean; tasks reduce their centred rows, block by block, to a triangular factor (QR),
   and factors are stacked and reduced again in rounds until a bounded number of them is left for the driver.
   The product of rows is never formed, so small singular values keep their digits.
2. On that one factor, whose size depends on the dimension alone: Householder reflections make it bidiagonal, ``dqds``
   finds the squared singular values to high relative accuracy, ``twisted`` factorisations give the right singular
   vectors of the bidiagonal, and the reflections turn them into whitening directions.
3. A pass measures the covariance of the whitened rows, another returns them.

Vectors of different dimension are whitened apart, each dimension by its own mean and directions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtide.llm.common import materialize, whole_groups

#: Entries become floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1_024, 100_000
COMPONENTS = 8
#: Rows that a task reduces together (at least twice the dimension), and factors that are stacked in a round.
BLOCK, STACK = 4_096, 32
#: Entries of this size or more count as not finite: their numbers would not be exact.
LIMIT = 2.0**40

_EPS = float(np.finfo(float).eps)
#: What may be neglected, as a share of a squared singular value.
_TINY = (4 * _EPS) ** 2


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and the right-hand reflections that make a square matrix upper bidiagonal."""
    a = r.astype(float).copy()
    n = len(a)
    right: list[np.ndarray] = []
    for k in range(n):
        v = _reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= np.outer(v, 2 * (v @ a[k:, k:]))
        v = _reflector(a[k, k + 1 :]) if k < n - 2 else None
        if v is not None:
            a[k:, k + 1 :] -= np.outer(2 * (a[k:, k + 1 :] @ v), v)
        right.append(v if v is not None else np.zeros(max(n - k - 1, 0)))
    return a.diagonal().copy(), a.diagonal(1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit vector of the reflection that leaves only the first entry of ``x``; None if there is nothing to do."""
    size = np.abs(x).max(initial=0.0)
    if not size or not np.abs(x[1:]).max(initial=0.0):
        return None
    v = x / size
    v[0] += math.copysign(float(np.linalg.norm(v)), v[0])
    return v / np.linalg.norm(v)


def reflect_back(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """Turn a right singular vector of the bidiagonal into one of the matrix it came from."""
    out = z.copy()
    for k in range(len(right) - 1, -1, -1):
        if len(right[k]):
            out[k + 1 :] -= right[k] * (2 * float(right[k] @ out[k + 1 :]))
    return out


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference step: new q, new e, and the pivots that must not be negative."""
    new_q, new_e, pivots = [], [], []
    d = q[0] - shift
    for k in range(len(e)):
        pivots.append(d)
        total = d + e[k]
        ratio = q[k + 1] / total if total else math.inf
        new_q.append(total)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    pivots.append(d)
    new_q.append(d)
    return new_q, new_e, pivots


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling.

    Shifts start from the smaller eigenvalue of the last two rows; one that proves too large falls back to what its
    last pivot says, then to the bound 1 / sum(1 / pivot) of a step without shift, which is never too large.
    """
    top = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(upper).max(initial=0)))
    if not top:
        return np.zeros(len(diagonal))
    # A zero on the diagonal is a singular value of zero within rounding: it may as well be this small.
    q = [max((float(x) / top) ** 2, _EPS**3) for x in diagonal]
    e = [(float(x) / top) ** 2 for x in upper]
    found: list[float] = []
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while len(q) > 1:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= _TINY * (moved + min(q[k], q[k + 1]))), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:  # small ones to the end: the matrix turned round has the same values
                q, e = q[::-1], e[::-1]
            half = (q[-2] + e[-1] + q[-1]) / 2
            low = q[-2] * q[-1] / (half + math.sqrt(max(half * half - q[-2] * q[-1], 0.0)))
            shift = low * (1 - 2 * _EPS)
            for attempt in range(4):
                new_q, new_e, pivots = _step(q, e, shift)
                if min(pivots) >= 0 and not any(math.isnan(x) for x in new_q):
                    break
                if attempt == 0 and min(pivots[:-1]) >= 0 and pivots[-1] + shift > 0:
                    shift = (shift + pivots[-1]) * (1 - 4 * _EPS)
                elif attempt <= 1:
                    still = _step(q, e, 0.0)[2]
                    shift = 1 / sum(1 / x for x in still) * (1 - 8 * _EPS * len(q)) if min(still) > 0 else 0.0
                else:
                    shift = 0.0
            q, e, moved = new_q, new_e, moved + shift
        found += [x + moved for x in q]
    return np.sort(np.array(found))[::-1] * top * top


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float, start: np.ndarray | None = None) -> np.ndarray:
    """Unit right singular vector of a bidiagonal matrix for the squared singular value ``value``.

    The product matrix less ``value`` is factored from both ends; the factors meet where the pivot is smallest, and the
    vector follows from there without cancellation. ``start`` solves for that right-hand side instead.
    """
    n = len(diagonal)
    square, product = (diagonal * diagonal).tolist(), (diagonal[: n - 1] * upper).tolist()
    tiny = _EPS * max(value, max(square), _EPS**8)
    # s: what is left of each pivot from the front, p: from the back (differential forms, no subtraction of large numbers)
    lower, s, down = [0.0] * n, [-value] * n, [0.0] * n
    for i in range(n - 1):
        down[i] = (square[i] + s[i]) or tiny
        lower[i] = product[i] / down[i]
        s[i + 1] = lower[i] * float(upper[i]) / float(diagonal[i]) * s[i] - value if diagonal[i] else float(upper[i]) ** 2 - lower[i] * product[i] - value
    above, p, up = [0.0] * n, [0.0] * n, [0.0] * n
    p[n - 1] = square[n - 1] - value
    for i in range(n - 2, -1, -1):
        up[i + 1] = (float(upper[i]) ** 2 + p[i + 1]) or tiny
        above[i] = product[i] / up[i + 1]
        p[i] = p[i + 1] * square[i] / up[i + 1] - value
    gamma = [s[i] + p[i] + value for i in range(n)]
    if start is None:
        r = min(range(n), key=lambda i: abs(gamma[i]))
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -above[i] * z[i]
        return z / np.linalg.norm(z)
    r = min(range(n), key=lambda i: abs(gamma[i]))
    y = start.astype(float).copy()
    for i in range(r):
        y[i + 1] -= lower[i] * y[i]
    for i in range(n - 2, r - 1, -1):
        y[i] -= above[i] * y[i + 1]
    z = np.array([y[i] / (down[i] if i < r else up[i] if i > r else gamma[r] or tiny) for i in range(n)])
    for i in range(r - 1, -1, -1):
        z[i] -= lower[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] -= above[i] * z[i]
    return z / np.linalg.norm(z)


def _cleared(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for other in others:
        z = z - other * float(other @ z)
    return z


def right_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray, wanted: int) -> np.ndarray:
    """Rows: unit right singular vectors of the first ``wanted`` squared singular values, at right angles.

    Values that are next to equal have no vectors of their own, only a common space: there each new vector is
    cleared of those before, and found again from a random start if little of it was left.
    """
    random = np.random.default_rng(len(diagonal))
    out: list[np.ndarray] = []
    for k in range(wanted):
        near = [out[j] for j in range(k) if values[j] - values[k] <= 1e-3 * values[0]]
        z = twisted(diagonal, upper, float(values[k]))
        for _ in range(20):
            left = _cleared(z, near)
            size = float(np.linalg.norm(left))
            if size > 0.05:
                z = left / size
                break
            fresh = _cleared(random.normal(size=len(z)), near)
            z = twisted(diagonal, upper, float(values[k]), fresh / np.linalg.norm(fresh))
        z = _cleared(z, near)
        out.append(z / np.linalg.norm(z))
    return np.array(out).reshape(wanted, len(diagonal))


@dataclass
class Whitening:
    """What whitens rows of one dimension: count, sums, directions (rows), their eigenvalues and the whole variance."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times the distance from the mean, exactly."""
        return self.n * x - self.sums

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.directions.T / np.sqrt(self.eigenvalues)


def solve(n: int, sums: np.ndarray, r: np.ndarray, components: int) -> Whitening:
    """Directions of the largest variance from the triangular factor of the centred rows.

    Directions without variance (within rounding) can't be whitened and are left out.
    """
    diagonal, upper, right = bidiagonalise(r)
    values = dqds(diagonal, upper)
    least = values[0] * (max(len(values), 8) * _EPS) ** 2 if len(values) else 0.0
    wanted = min(components, int((values > least).sum()))
    vectors = right_vectors(diagonal, upper, values, wanted)
    directions = np.array([reflect_back(z, right) for z in vectors]).reshape(wanted, len(values))
    return Whitening(n, sums, directions, values[:wanted] / n, float(values.sum()) / n)


def _integers(vectors: pa.Array) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values).astype(np.int64).reshape(len(vectors), -1) + SHIFT


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    widths = batch.column(column).value_lengths().to_numpy()
    for width in np.unique(widths):
        yield batch if (widths == width).all() else batch.filter(pa.array(widths == width))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of one dimension in blocks of bounded size, from batches whose first column is the vector."""
    held: dict[int, list[np.ndarray]] = {}
    for whole in batches:
        for batch in _by_width(whole, 0) if whole.num_rows else ():
            x = _integers(batch.column(0))
            own = held.setdefault(x.shape[1], [])
            own.append(x)
            if sum(map(len, own)) >= max(BLOCK, 2 * x.shape[1]):
                yield np.concatenate(own)
                del held[x.shape[1]]
    for own in held.values():
        yield np.concatenate(own)


def _merge_rounds(parts: DataFrame, merge: Callable[[int, list[bytes]], bytes]) -> dict[int, bytes]:
    """(width, part, state) rows merged in rounds of ``STACK`` until one is left of each width; the driver gets those."""
    parts = materialize(parts, "states")
    rows = parts.groupBy("width").count().agg(F.max("count")).first()[0] or 0
    while rows > 1:
        rows = math.ceil(rows / STACK)

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, "cell"):
                widths, cells = (table.column(c).to_pylist() for c in ("width", "cell"))
                states = table.column("state").to_pylist()
                at = 0
                while at < len(cells):
                    to = at
                    while to < len(cells) and cells[to] == cells[at]:
                        to += 1
                    # numbered anew: states of one width share no number
                    yield pa.RecordBatch.from_arrays([pa.array([widths[at]], pa.int32()), pa.array([cells[at]]), pa.array([merge(widths[at], states[at:to])], pa.binary())], names=["width", "part", "state"])
                    at = to

        cell = F.xxhash64("width", F.pmod(F.xxhash64("part"), F.lit(rows)))
        dealt = parts.select("width", cell.alias("cell"), "state").repartition(rows, "cell").sortWithinPartitions("cell", F.xxhash64("state"))
        parts = materialize(dealt.mapInArrow(reduce, "width int, part long, state binary"), "states")
    return {r.width: bytes(r.state) for r in parts.collect()}


def _factor(stacked: np.ndarray) -> np.ndarray:
    """Triangular factor of rows, filled up with zero rows to a square."""
    r = np.linalg.qr(stacked, mode="r")
    return np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))]) if len(r) < r.shape[1] else r


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each dimension that the vectors of the only column of ``rows`` have."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for x in _blocks(batches):
            own = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
            own[0], own[1] = own[0] + len(x), own[1] + x.sum(0)
        for width, (n, sums) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width + 1, width, np.int32)), pa.array(np.arange(-1, width, dtype=np.int32)), pa.array(np.append(n, sums))], names=["width", "place", "total"])

    totals: dict[int, dict[int, int]] = {}
    added = rows.mapInArrow(add, "width int, place int, total long").groupBy("width", "place").agg(F.sum("total").alias("total"))
    for width, place, total in added.toLocalIterator():
        totals.setdefault(width, {})[place] = total
    known = {width: (own[-1], np.array([own[i] for i in range(width)], np.int64)) for width, own in totals.items()}
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors: dict[int, np.ndarray] = {}
        for x in _blocks(batches):
            n, sums = shared.value[x.shape[1]]
            centred = (n * x - sums) / n
            last = factors.get(x.shape[1])
            factors[x.shape[1]] = _factor(centred if last is None else np.vstack([last, centred]))
        for width, r in factors.items():
            if width:
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["width", "state"])

    factors = rows.mapInArrow(reduce, "width int, state binary").select("width", F.xxhash64("state", F.monotonically_increasing_id()).alias("part"), "state")
    merged = _merge_rounds(factors, lambda width, states: _factor(np.vstack([np.frombuffer(s).reshape(width, width) for s in states])).tobytes())
    return {width: solve(*known[width], np.frombuffer(r).reshape(width, width), components) for width, r in merged.items()}


def identity_errors(rows: DataFrame, fitted: dict[int, Whitening]) -> dict[int, float]:
    """Of each dimension, the largest entry of the whitened rows' covariance less the identity."""
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        for x in _blocks(batches):
            width = x.shape[1]
            if width not in shared.value:
                continue
            w = shared.value[width].whiten(x)
            mean = w.mean(0)
            state = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).reshape(-1)]).tobytes()
            held[width] = _merge_moments(width, [held[width], state]) if width in held else state
        for width, state in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([state], pa.binary())], names=["width", "state"])

    parts = rows.mapInArrow(moments, "width int, state binary").select("width", F.xxhash64("state", F.monotonically_increasing_id()).alias("part"), "state")
    out = {}
    for width, state in _merge_rounds(parts, _merge_moments).items():
        values = np.frombuffer(state)
        k = len(fitted[width].eigenvalues)
        out[width] = float(np.abs(values[1 + k :].reshape(k, k) / values[0] - np.eye(k)).max(initial=0.0))
    return out


def _merge_moments(width: int, states: list[bytes]) -> bytes:
    """Count, mean and centred products of the union of several parts."""
    n, mean, products = 0.0, 0.0, 0.0
    for state in states:
        values = np.frombuffer(state)
        k = (math.isqrt(4 * len(values) - 3) - 1) // 2
        m, own, more = values[0], values[1 : 1 + k], values[1 + k :].reshape(k, k)
        far = own - mean
        products = products + more + np.outer(far, far) * (n * m / (n + m))
        mean = mean + far * (m / (n + m))
        n += m
    return np.concatenate([[n], mean, products.reshape(-1)]).tobytes()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id_col``, n, deviation, identity_error and arrays whitened and explained of each vector.

    Entries count as floor(1024 * entry) + 100000. ``deviation`` is the sum of (n * x - sum of all x)^2, exact;
    ``whitened`` holds the projections on the directions of largest variance (at most ``components``, less where fewer
    directions have any), divided by their standard deviation; ``explained`` each one's share of the variance.
    Vectors that are null or hold null, non-finite or enormous (``LIMIT``) entries take no part and have no row; a
    vector without entries has no components. Dimensions are whitened apart. Rows without id and repeated rows count
    and are returned like any other; other columns are left out. An empty table gives no rows.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT))
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = named.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    fitted = fit(rows.select("v"), components)
    errors = identity_errors(rows.select("v"), fitted)
    shared = rows.sparkSession.sparkContext.broadcast((fitted, errors))
    schema = T.StructType(
        [
            T.StructField(id_col, vectors.schema[id_col].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("identity_error", T.DoubleType()),
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
            T.StructField("explained", T.ArrayType(T.DoubleType())),
        ]
    )

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, errors = shared.value
        for whole in batches:
            for batch in _by_width(whole, 1) if whole.num_rows else ():
                x = _integers(batch.column(1))
                own = fitted.get(x.shape[1])
                if own is None:
                    own = Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
                far, k = own.centred(x), len(own.eigenvalues)
                if far.size and float(np.abs(far).max()) ** 2 * far.shape[1] >= 2.0**62:
                    squares = [sum(a * a for a in row) for row in far.tolist()]
                else:
                    squares = (far * far).sum(1).tolist()
                white = own.whiten(x) if k else np.zeros((len(x), 0))
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
                columns = [
                    batch.column(0),
                    pa.array(np.full(len(x), own.n)),
                    pa.array(squares, pa.decimal128(38, 0)),
                    pa.array(np.full(len(x), errors.get(x.shape[1], 0.0))),
                    pa.ListArray.from_arrays(ends, pa.array(white.reshape(-1))),
                    pa.ListArray.from_arrays(ends, pa.array(np.tile(own.eigenvalues / own.trace, len(x)) if k else np.zeros(0))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(project, schema)


def whitening_report(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component, numbered from 1; a deviation too large for a long integer is null there."""
    found = whiten(vectors, id_col)
    each = found.select(id_col, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c"))
    return each.select(
        id_col,
        (F.col("place") + 1).alias("component"),
        "n",
        F.col("deviation").try_cast("long").alias("deviation"),
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        "identity_error",
    )
