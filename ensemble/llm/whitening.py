"""Embedding whitening by an incremental eigendecomposition (operator 11).

Entries become integers x = floor(64 * c) + 1000000. Each partition keeps the
count, mean and eigendecomposition of its scatter matrix and applies centred
rank-one updates to it: the eigenvalues of diag(d) + z z' are the roots of the
secular equation 1 + sum(z_i^2 / (d_i - e)) = 0, found one between each two
neighbouring d; entries of z that are small and d that are equal are deflated
before. Rows come in blocks: an orthogonal triangularisation turns a block's
centred rows into as many rows as there are dimensions with the same scatter, and
each of these, then the block's mean, is one update; so a vector costs a few
multiplications a dimension, not a whole update. The partitions' spectra are
combined in a tree, the eigenpairs of one applied to the other as successive
rank-one updates. A last pass over all vectors projects them, centred by their
exact mean, on the basis found; the eigenpairs of that small Gram matrix
(Rayleigh-Ritz) are the components, to double precision whatever rounding the
updates left.

Of each partition one row of dim^2 numbers is kept, and FAN of them meet in a
task; the driver holds the last one.

Defined cases: rows whose vector is null or empty, holds a null or non-finite
entry or one with |64 * c| of 2^50 or more are dropped, and so are vectors of
another length than most (the shortest of equally frequent lengths); repeated
rows count each time; null vec_ids stay; a component without variance (of at most
1e-13 of the trace) has a null ``whitened`` and takes no part in
``identity_error``, which is 0 where none has any; ``explained`` is 0 where the
trace is; a ``deviation`` beyond a long is null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, saved
from .similar import runs

#: Fixed values of the integer form of an entry.
SCALE, SHIFT = 64, 1_000_000
#: Vectors in a block; spectra or sums that one task combines.
BLOCK, FAN = 8192, 32
#: Share of the trace up to which an eigenvalue counts as none.
NONE = 1e-13
_EPS = np.finfo(float).eps


# ---------------------------------------------------------------- rank-one updates

def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots e of 1 + sum(z2_i / (d_i - e)), d rising and distinct, z2 > 0; and the matrix d_i - e_j.

    A root is kept as its distance from the nearer d, so that small differences
    keep their leading digits.
    """
    m, at = len(d), np.arange(len(d))
    top = d[-1] + z2.sum()
    above = np.append(d[1:], top)
    gap = above - d
    mid = 1 + (z2[:, None] / (d[:, None] - (d + gap / 2))).sum(axis=0)
    left = (mid >= 0) | (at == m - 1)
    origin = np.where(left, at, np.minimum(at + 1, m - 1))
    base = d[:, None] - d[origin]
    upper = above - d[origin]
    lo = np.where(left, 0.0, -gap / 2)
    hi = np.where(left, np.where(at == m - 1, gap, gap / 2), 0.0)
    mu = (lo + hi) / 2
    below = at[:, None] <= at  # poles up to the root's interval
    for _ in range(80):
        diff = base - mu
        t = z2[:, None] / diff
        f = 1 + t.sum(axis=0)
        done = np.abs(f) <= 4 * _EPS * (1 + np.abs(t).sum(axis=0))
        lo, hi = np.where(f < 0, mu, lo), np.where(f < 0, hi, mu)
        if done.all():
            break
        s = t / diff
        slope_l, slope_r = np.where(below, s, 0).sum(axis=0), np.where(below, 0, s).sum(axis=0)
        # the root of c + s1 / (d_j - e) + s2 / (d_j+1 - e) with the same value and slopes
        a1, a2 = diff[at, at], upper - mu
        c = f - a1 * slope_l - a2 * slope_r
        a = (a1 + a2) * f - a1 * a2 * (slope_l + slope_r)
        b = a1 * a2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = mu + step
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        mu = np.where(done | (new == mu), mu, new)
    return d[origin] + mu, base - mu


def rank_one(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs (values rising, vectors in columns) of vectors diag(values) vectors' + row row'."""
    size = float(row @ row)
    if size == 0:
        return values, vectors
    d, q, z = values, vectors, vectors.T @ row
    small = 8 * _EPS * max(float(d[-1]), size)
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > small)
    if not len(live):
        return values, vectors
    if (np.diff(d[live]) <= small).any():
        # equal values: a rotation moves the weight of one direction to the next
        q, z, kept, last = q.copy(), z.copy(), [], int(live[0])
        for i in live[1:].tolist():
            if d[i] - d[last] <= small:
                r = np.hypot(z[last], z[i])
                c, s = z[i] / r, z[last] / r
                q[:, [last, i]] = q[:, [last, i]] @ np.array([[c, s], [-s, c]])
                z[last], z[i] = 0.0, r
            else:
                kept.append(last)
            last = i
        live = np.array([*kept, last])
    dl, zl = d[live], z[live]
    m = len(live)
    if m == 1:
        roots, turned = dl + zl**2, q[:, live]
    else:
        roots, diff = secular_roots(dl, zl**2)
        # the z for which these roots are exact: its vectors are orthogonal to rounding
        gap = dl[None, :] - dl[:, None]
        at = np.arange(m - 1)
        den = np.where(at < np.arange(m)[:, None], gap[:, :-1], gap[:, 1:])
        fitted = np.sqrt(np.abs(np.prod(-diff[:, :-1] / den, axis=1) * diff[:, -1]))
        w = np.copysign(fitted, zl)[:, None] / diff
        turned = q[:, live] @ (w / np.linalg.norm(w, axis=0))
    rest = np.setdiff1d(np.arange(len(d)), live)
    values = np.concatenate([d[rest], roots])
    order = np.argsort(values, kind="stable")
    return values[order], np.concatenate([q[:, rest], turned], axis=1)[:, order]


@dataclass
class Spectrum:
    """Count, mean and eigenpairs of the scatter matrix of the rows seen."""

    dim: int
    n: int = 0
    mean: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)
    vectors: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.mean is None:
            self.mean, self.values, self.vectors = np.zeros(self.dim), np.zeros(self.dim), np.eye(self.dim)

    def _apply(self, row: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, row)

    def _shift(self, n: int, mean: np.ndarray) -> None:
        """The update for the distance of the means, as the other side's n rows come in."""
        total, gap = self.n + n, mean - self.mean
        if self.n:
            self._apply(gap * np.sqrt(self.n / total * n))
        self.mean, self.n = self.mean + gap * (n / total), total

    def add(self, rows: np.ndarray) -> None:
        mean = rows.mean(axis=0)
        for r in np.linalg.qr(rows - mean, mode="r"):
            self._apply(r)
        self._shift(len(rows), mean)

    def combine(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._apply(vector * np.sqrt(value))
        self._shift(other.n, other.mean)


# ---------------------------------------------------------------- passes over the vectors

def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    """x - SHIFT of the vectors of a batch."""
    c = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(SCALE * c).astype(np.int64)


def _part() -> int:
    return TaskContext.get().partitionId()


STATE = "part long, n long, sums array<decimal(38,0)>, state array<double>"


def _state(part: int, n: int, sums, state: np.ndarray) -> pa.RecordBatch:
    exact = [Decimal(int(x)) for x in sums]
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int64()), "n": pa.array([n], pa.int64()),
        "sums": pa.array([exact], pa.list_(pa.decimal128(38, 0))), "state": pa.array([state.ravel()], pa.list_(pa.float64()))})


def _packed(s: Spectrum) -> np.ndarray:
    return np.concatenate([s.mean, s.values, s.vectors.ravel()])


def _unpacked(n: int, x: np.ndarray, dim: int) -> Spectrum:
    return Spectrum(dim, n, x[:dim], x[dim : 2 * dim], x[2 * dim :].reshape(dim, dim))


def _spectra(dim: int):
    """One row a partition: its count, exact sums and spectrum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums, held, rows = Spectrum(dim), [0] * dim, [], 0
        for b in batches:
            x = _matrix(b, dim)
            if not len(x):
                continue
            sums = [s + int(t) for s, t in zip(sums, x.sum(axis=0))]
            held.append(x.astype(float))
            rows += len(x)
            if rows >= BLOCK:
                spectrum.add(np.concatenate(held))
                held, rows = [], 0
        if rows:
            spectrum.add(np.concatenate(held))
        if spectrum.n:
            yield _state(_part(), spectrum.n, sums, _packed(spectrum))
    return run


def _combined(dim: int):
    def merge(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
        left = _unpacked(n, a, dim)
        left.combine(_unpacked(m, b, dim))
        return _packed(left)
    return merge


def _added(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    return a + b


def _tree(merge: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["grp"]):
            n, sums, state = 0, None, None
            for r in range(t.num_rows):
                more, exact = t.column("n")[r].as_py(), t.column("sums")[r].as_py()
                x = t.column("state")[r].values.to_numpy()
                state = x if state is None else merge(state, n, x, more)
                sums = exact if sums is None else [a + b for a, b in zip(sums, exact)]
                n += more
            yield _state(t.column("grp")[0].as_py(), n, sums, state)
    return run


def fold(rows: DataFrame, merge: Callable):
    """The one row left of a table of states, FAN of which are merged in a task at a time (None: no rows)."""
    rows = saved(rows)
    while (left := rows.count()) > 1:
        tasks = -(-left // FAN)
        numbered = rows.withColumn("grp", F.floor(F.col("part") / FAN)).repartition(tasks, "grp").sortWithinPartitions("grp", "part")
        rows = saved(map_arrow(numbered, _tree(merge), STATE))
    return rows.first()


def _centred(x: np.ndarray, middle) -> np.ndarray:
    whole, part = middle  # the exact mean, as integers and what is left below one
    return (x - whole) - part


def _gram(shared, dim: int):
    """Gram matrix of a partition's centred vectors on the basis, and the sums there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, basis = shared.value
        k = basis.shape[1]
        n, gram, line = 0, np.zeros((k, k)), np.zeros(k)
        for b in batches:
            y = _centred(_matrix(b, dim), middle) @ basis
            n, gram, line = n + len(y), gram + y.T @ y, line + y.sum(axis=0)
        if n:
            yield _state(_part(), n, [], np.concatenate([line, gram.ravel()]))
    return run


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n * x - S)^2 of each row; null beyond a long."""
    s = np.array(sums, object)
    far = max((abs(n * int(v) - t) for extreme in (x.max(axis=0), x.min(axis=0)) for v, t in zip(extreme, sums)), default=0)
    if far * far * len(sums) < 1 << 63 and n * (1 << 51) < 1 << 63:
        gap = n * x - s.astype(np.int64)
        return (gap * gap).sum(axis=1).tolist()
    gap = x.astype(object) * n - s
    return [v if v < 1 << 63 else None for v in (gap * gap).sum(axis=1)]


def _whitened(shared, dim: int, n: int, sums: list[int], explained: list[float], live: list[bool], error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, basis = shared.value
        k = len(explained)
        number, share = np.arange(1, k + 1, dtype=np.int32), np.array(explained)
        for b in batches:
            if not b.num_rows:
                continue
            x, rows = _matrix(b, dim), b.num_rows
            w = np.zeros((rows, k))
            w[:, live] = _centred(x, middle) @ basis
            deviation = pa.array(_deviation(x, n, sums), pa.int64())
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id").take(each), "component": np.tile(number, rows), "n": np.full(rows * k, n, np.int64),
                "deviation": deviation.take(each), "whitened": pa.array(w.ravel(), mask=np.tile(~np.array(live), rows)),
                "explained": np.tile(share, rows), "identity_error": np.full(rows * k, error)})
    return run


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def clean_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v of the rows that take part; their length, 0 for none)."""
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 50) / SCALE))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")) \
        .filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(fits)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return (rows, 0) if common is None else (rows.filter(F.size("v") == common.dim), common.dim)


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: every vector on the first components."""
    spark = vectors.sparkSession
    rows, dim = clean_vectors(vectors)
    if not dim:
        return spark.createDataFrame([], SCHEMA)
    every = rows.select("v")
    total = fold(map_arrow(every, _spectra(dim), STATE), _combined(dim))
    n, sums = total.n, [int(s) for s in total.sums]
    whole = [(2 * s + n) // (2 * n) for s in sums]
    middle = np.array(whole, np.int64), np.array([float(s - n * w) / n for s, w in zip(sums, whole)])

    # Rayleigh-Ritz on the span found, which is the whole space
    basis = np.linalg.qr(_unpacked(n, np.array(total.state), dim).vectors[:, ::-1])[0]
    found = np.array(fold(map_arrow(every, _gram(spark.sparkContext.broadcast((middle, basis)), dim), STATE), _added).state)
    gram = found[dim:].reshape(dim, dim) / n - np.outer(found[:dim], found[:dim]) / n / n
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    trace = float(np.trace(gram))
    live = (values > NONE * trace).tolist()
    explained = [max(0.0, float(v)) / trace if trace > 0 else 0.0 for v in values]
    scaled = spark.sparkContext.broadcast((middle, (basis @ turn)[:, live] / np.sqrt(values[live])))
    error, k = 0.0, sum(live)
    if k:
        after = np.array(fold(map_arrow(every, _gram(scaled, dim), STATE), _added).state)
        cov = after[k:].reshape(k, k) / n - np.outer(after[:k], after[:k]) / n / n
        error = float(np.abs(cov - np.eye(k)).max())
    return map_arrow(rows, _whitened(scaled, dim, n, sums, explained, live, error), SCHEMA)
