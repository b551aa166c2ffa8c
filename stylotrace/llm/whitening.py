"""Whitening of embeddings by incremental eigendecomposition.

Vectors are put on a grid of 1/256, and each distinct one is fitted once. A task keeps the spectrum of the scatter of
its rows and adds every row as a centred rank-one update: the new eigenvalues are the roots of a secular equation, one
between each two old ones; entries of the update that do not matter, and all but one of equal eigenvalues, are
deflated first. Spectra are combined in a tree, each time by the rank-one updates that the eigenvectors of one spectrum
and the distance of the means are for the other. The last step is a distributed Rayleigh-Ritz refinement: rows are
centred on the exact mean and projected on the combined basis, the small covariance there is added up and
diagonalised, which leaves the eigenvectors of the covariance to double precision.

What leaves a task is a spectrum or a matrix of the square of the dimension, whose size is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylotrace.llm.support import stored

GRID = 256
COMPONENTS = 4
DIMENSIONS_LIMIT = 2048  # a spectrum of so many dimensions has 32 MB
ROWS_PER_SPECTRUM = 2048  # at least, as long as there are cores without work
FAN = 16  # spectra or matrices that are combined at a time
EPS = np.finfo(np.float64).eps
WHOLE = float(1 << 62)


# Rank-one updates ------------------------------------------------------------------------------


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z[j]**2 / (d[j] - x)) = 0, one right of each d: the nearest pole's index and the distance from it.

    ``d`` ascends without ties and no z is 0. All roots take each step together: the two poles beside a root are
    interpolated, and a step that leaves the root's bracket halves the bracket instead.
    """
    k, squares = len(d), z * z
    if k == 1:
        return np.zeros(1, np.int64), squares.copy()
    right = np.append(d[1:], d[-1] + squares.sum())
    half = (right - d) / 2
    each = np.arange(k)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1 + (squares[:, None] / (d[:, None] - d - half)).sum(axis=0)
        nearer_left = (middle >= 0) | (each == k - 1)  # beyond the last pole there is no other
        origin = each + ~nearer_left
        delta = d[:, None] - d[origin]
        low = np.where(nearer_left, 0.0, -half)
        high = np.where(nearer_left, half, 0.0)
        if middle[-1] < 0:
            low[-1], high[-1] = half[-1], 2 * half[-1]
        x = (low + high) / 2
        left_of = np.tri(k, dtype=bool).T  # [j, i]: pole j is not right of root i
        to_left, to_right = d - d[origin], right - d[origin]
        for _ in range(60):
            apart = delta - x
            part = squares[:, None] / apart
            value = 1 + part.sum(axis=0)
            slopes = part / apart
            slope = slopes.sum(axis=0)
            slope_left = np.where(left_of, slopes, 0.0).sum(axis=0)
            low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
            done = np.abs(value) <= 4 * EPS * k * (1 + np.abs(part).sum(axis=0))
            if (done | (high - low <= 2 * EPS * np.abs(high + low))).all():
                break
            l, r = to_left - x, to_right - x
            a = (l + r) * value - l * r * slope
            b = l * r * value
            c = value - l * slope_left - r * (slope - slope_left)
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            ahead = x + step
            x = np.where(done, x, np.where((ahead > low) & (ahead < high), ahead, (low + high) / 2))
    return origin, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``vectors @ diag(values) @ vectors.T + outer(v, v)``; eigenvalues ascend, eigenvectors are columns."""
    z = vectors.T @ v
    size = float(z @ z)
    if size == 0:
        return values, vectors
    slack = 8 * EPS * max(float(values[-1]), size)
    # Of equal eigenvalues one takes the whole entry: their eigenvectors are reflected.
    edges = np.flatnonzero(np.diff(values) > slack) + 1
    if len(edges) < len(values) - 1:
        vectors = vectors.copy()
        for a, b in zip([0, *edges], [*edges, len(values)], strict=True):
            length = np.sqrt(z[a:b] @ z[a:b])
            if b - a > 1 and length > 0:
                w = z[a:b].copy()
                sign = 1.0 if w[-1] >= 0 else -1.0
                w[-1] += sign * length
                vectors[:, a:b] -= np.outer(vectors[:, a:b] @ w, 2 / (w @ w) * w)
                z[a:b] = 0
                z[b - 1] = -sign * length
    active = np.flatnonzero(np.abs(z) * np.sqrt(size) > slack)
    if not len(active):
        return values, vectors
    d, z = values[active], z[active]
    origin, x = secular_roots(d, z)
    apart = (d[:, None] - d[origin]) - x  # old minus new eigenvalues
    # The entries for which these roots are exact give eigenvectors that are orthogonal to working precision.
    with np.errstate(divide="ignore", invalid="ignore"):
        between = d - d[:, None]
        np.fill_diagonal(between, 1.0)
        z = np.where(z < 0, -1.0, 1.0) * np.sqrt(np.abs(np.prod(-apart / between, axis=1)))
        turn = z[:, None] / np.where(apart == 0, EPS * EPS, apart)
        turn /= np.sqrt((turn * turn).sum(axis=0))
    values, old = values.copy(), vectors
    values[active] = d[origin] + x
    vectors = old.copy()
    vectors[:, active] = old[:, active] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Eigendecomposition of the scatter of ``n`` rows around their mean, with the rows' exact sums."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(d: int) -> Spectrum:
        return Spectrum(0, np.zeros(d, np.int64), np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, row: np.ndarray) -> None:
        away = row - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, np.sqrt(self.n / (self.n + 1)) * away)
        self.n += 1
        self.mean = self.mean + away / self.n

    def combine(self, other: Spectrum) -> None:
        n = self.n + other.n
        away = other.mean - self.mean
        for k in np.flatnonzero(other.values > EPS * other.values[-1]):
            self.values, self.vectors = rank_one(self.values, self.vectors, np.sqrt(other.values[k]) * other.vectors[:, k])
        self.values, self.vectors = rank_one(self.values, self.vectors, np.sqrt(self.n / n * other.n) * away)
        self.mean = self.mean + away * (other.n / n)
        self.n, self.sums = n, _added(self.sums, other.sums)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if (np.abs(a.astype(np.float64)) + np.abs(b.astype(np.float64)) >= WHOLE).any():
        raise OverflowError("sums of the vectors exceed 64 bits")
    return a + b


# Spark -----------------------------------------------------------------------------------------


def gridded(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the grid points of all vectors that are not null, not empty and hold finite entries only."""
    entries = F.col(vector_col).cast("array<double>")
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~odd
    points = F.transform(entries, lambda c: F.floor(F.lit(float(GRID)) * c) + F.lit(0).cast("long"))
    return vectors.where(usable).select(F.col(id_col).alias("id"), points.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


STATE = ["part", "n", "sums", "mean", "values", "vectors"]
STATE_SQL = "part long, n long, sums binary, mean binary, `values` binary, vectors binary"


def _packed(part: int, s: Spectrum) -> pa.RecordBatch:
    arrays = [[part], [s.n], *[[a.tobytes()] for a in (s.sums, s.mean, s.values, np.ascontiguousarray(s.vectors))]]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], STATE)


def _unpacked(row: dict) -> Spectrum:
    floats = [np.frombuffer(row[c], np.float64) for c in ("mean", "values", "vectors")]
    d = len(floats[0])
    return Spectrum(row["n"], np.frombuffer(row["sums"], np.int64), floats[0], floats[1], floats[2].reshape(d, d))


def _folded(states: DataFrame, schema: str, parts: int, merge: Callable[[pa.Table, int], pa.RecordBatch]) -> dict | None:
    """Combine states, FAN at a time and every round in parallel, until one is left."""
    while parts > 1:
        parts = -(-parts // FAN)

        def run(key: tuple, group: pa.Table) -> pa.Table:
            return pa.Table.from_batches([merge(group.sort_by("part"), key[0].as_py())])

        states = states.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(run, schema)
        states = stored(states, "fold")
    row = states.first()
    return row.asDict() if row else None


def fitted_spectrum(points: DataFrame, d: int, parts: int) -> Spectrum | None:
    """The spectrum of all rows of (x)."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Spectrum.empty(d)
        for batch in batches:
            rows = _matrix(batch.column("x"), d)
            if len(rows) * float(np.abs(rows.astype(np.float64)).max(initial=0)) >= WHOLE:
                raise OverflowError("sums of the vectors exceed 64 bits")
            state.sums = _added(state.sums, rows.sum(axis=0))
            for row in rows.astype(np.float64):
                state.add(row)
        if state.n:
            yield _packed(TaskContext.get().partitionId(), state)

    def merge(group: pa.Table, part: int) -> pa.RecordBatch:
        states = map(_unpacked, group.to_pylist())
        first = next(states)
        for other in states:
            first.combine(other)
        return _packed(part, first)

    found = stored(points.mapInArrow(learn, STATE_SQL), "spectra")
    row = _folded(found, STATE_SQL, parts, merge)
    return _unpacked(row) if row else None


def projected_covariance(points: DataFrame, n: int, center: np.ndarray, basis: np.ndarray, parts: int) -> np.ndarray:
    """Covariance (divisor n) of the rows, centred and projected on the columns of ``basis``."""
    d, k = basis.shape
    shared = points.sparkSession.sparkContext.broadcast((center, basis))  # at most DIMENSIONS_LIMIT squared numbers
    schema, names = "part long, first binary, second binary", ["part", "first", "second"]

    def packed(part: int, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([part], pa.int64()), pa.array([first.tobytes()], pa.binary()), pa.array([second.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, columns = shared.value
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = (_matrix(batch.column("x"), d) - mean) @ columns
            first, second = first + y.sum(axis=0), second + y.T @ y
        yield packed(TaskContext.get().partitionId(), first, second)

    def merge(group: pa.Table, part: int) -> pa.RecordBatch:
        add = lambda c: sum(np.frombuffer(b, np.float64) for b in group.column(c).to_pylist())
        return packed(part, add("first"), add("second"))

    row = _folded(stored(points.mapInArrow(project, schema), "moments"), schema, parts, merge)
    first = np.frombuffer(row["first"], np.float64)
    return (np.frombuffer(row["second"], np.float64).reshape(k, k) - np.outer(first, first) / n) / n


@dataclass
class Whitening:
    """A fitted whitening: what it was fitted on, the leading components as columns, and what they explain."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(points: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct x of (id, x) once; None without rows.

    Components without variance (as when all vectors are equal) are left out. Vectors of different lengths are an error.
    """
    lengths = points.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    d = lengths["most"]
    if d is None:
        return None
    if lengths["least"] != d:
        raise ValueError(f"vectors of {lengths['least']} and of {d} entries in one table")
    if d > DIMENSIONS_LIMIT:
        raise ValueError(f"more than {DIMENSIONS_LIMIT} dimensions")
    once = stored(points.select("x").distinct(), "distinct")
    cores = points.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-once.count() // ROWS_PER_SPECTRUM), 4 * cores))
    once = stored(once.repartition(parts, "x").withColumn("deal", F.spark_partition_id()), "deal")
    once = once.repartition(parts, "deal").select("x")
    spectrum = fitted_spectrum(once, d, parts)
    n, center = spectrum.n, spectrum.sums / spectrum.n
    basis, _ = np.linalg.qr(spectrum.vectors)
    # Rayleigh-Ritz: the covariance within the basis, which spans everything, and its exact eigenvectors there.
    inner = projected_covariance(once, n, center, basis, parts)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    some = np.flatnonzero(values[:components] > d * EPS * max(values[0], 0.0))
    values, vectors = values[some], vectors[:, some] / np.sqrt((vectors[:, some] ** 2).sum(axis=0))
    error = 0.0
    if len(some):
        white = projected_covariance(once, n, center, vectors / np.sqrt(values), parts)
        error = float(np.abs(white - np.eye(len(some))).max())
    return Whitening(n, spectrum.sums, vectors, values, values / max(np.trace(inner), EPS * EPS), error)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every usable row and leading component.

    Rows whose vector is null, empty, or holds a null or an entry that is not finite have no result; repeated rows and
    equal ids have one each. ``component`` counts from 1 by falling eigenvalue. A table without usable rows, or whose
    vectors are all equal, gives no rows. Only the two named columns are looked at.
    """
    points = stored(gridded(vectors.select(id_col, vector_col), id_col, vector_col), "points")
    kind = dict(points.dtypes)["id"]
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(points, components)
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    k = len(model.eigenvalues)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n, d = m.n, len(m.sums)
        center, columns = m.sums / n, m.components / np.sqrt(m.eigenvalues)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            if (n * float(np.abs(x.astype(np.float64)).max(initial=0)) + np.abs(m.sums.astype(np.float64)).max()) >= WHOLE:
                raise OverflowError("n * x - S exceeds 64 bits")
            away = n * x - m.sums
            if ((away.astype(np.float64) ** 2).sum(axis=1) >= WHOLE).any():
                raise OverflowError("a deviation exceeds 64 bits")
            every = len(x) * k
            arrays = [
                batch.column("id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(every, n, np.int64)),
                pa.array(np.repeat((away * away).sum(axis=1), k)),
                pa.array(((x - center) @ columns).ravel()),
                pa.array(np.tile(m.explained, len(x))),
                pa.array(np.full(every, m.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return points.mapInArrow(project, schema)
