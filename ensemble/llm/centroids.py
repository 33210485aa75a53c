"""Centroid clustering with Ptolemaic pivots (operator 12).

Vectors become integers floor(1024 * x). Each of the rounds gives every vector
to its nearest centroid and moves each centroid to the floor of its vectors'
mean, all in whole numbers. For a few fixed pivots p, s the distance of every
vector to each is computed once and stored with it; as
d(v,p) d(c,s) <= d(v,c) d(p,s) + d(v,s) d(c,p) for any four points (Ptolemy), each
pair of pivots bounds d(v,c) from below by |d(v,p) d(c,s) - d(v,s) d(c,p)| / d(p,s)
without touching the vector. The centroid of the smallest bound is checked
exactly first; of the others only those whose bound, lowered by more than what
rounding can add, does not exceed the best distance found are checked on the
vectors, in whole numbers. So pruning never changes a result.

A round broadcasts the centroids (at most ``k`` vectors) and gets one row of sums
for each centroid from each partition; centroids are the only thing that passes
through the driver.

Defined cases: rows whose vector is null or not of ``dim`` components, or holds a
null or non-finite component or one with |1024 * x| of 2^27 or more (whose
distances a long cannot hold) take no part; repeated rows count each time; a null
vec_id is kept and hashed as an empty text; of equal hashes the smaller vector
comes first; fewer vectors than ``k`` give as many centroids, equal ones
included; an inertia beyond a long is null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, saved, written

#: Fixed values of the integer form and of the seed of the start.
SCALE, LIMIT, SEED = 1024, 1 << 27, 3
#: Pivots, pairs of them, and the vectors (of the smallest hashes) that they are chosen from.
PIVOTS, PAIRS, POOL = 6, 10, 64
#: Share by which a bound is lowered; its few roundings are below 2^-50 each.
MARGIN = 2.0**-46


def _matrix(col: pa.Array, dim: int, kind) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices (or of one to a vector)."""
    gap = a - b
    return (gap * gap).sum(axis=-1)


def pivots_of(pool: list[np.ndarray]) -> np.ndarray:
    """Up to PIVOTS different vectors of the pool, each the farthest from those before."""
    chosen = [pool[0]]
    near = squared(np.array(pool), chosen[0])
    while len(chosen) < PIVOTS and near.max() > 0:
        chosen.append(pool[int(np.argmax(near))])
        near = np.minimum(near, squared(np.array(pool), chosen[-1]))
    return np.array(chosen)


def pairs_of(pivots: np.ndarray) -> list[tuple[int, int, float]]:
    """The fixed pairs of pivots and their distances."""
    pairs = [(a, b, float(np.sqrt(squared(pivots[a], pivots[b]).astype(float)))) for a, b in combinations(range(len(pivots)), 2)]
    return pairs[:PAIRS]


def lower_bounds(to_pivots: np.ndarray, centre_to_pivots: np.ndarray, pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """Bounds below the distance of each vector (row) and centroid (column), safe against rounding."""
    out = np.zeros((len(to_pivots), len(centre_to_pivots)))
    for a, b, apart in pairs:
        x = to_pivots[:, a, None] * centre_to_pivots[None, :, b]
        y = to_pivots[:, b, None] * centre_to_pivots[None, :, a]
        out = np.maximum(out, (np.abs(x - y) - MARGIN * (x + y)) / apart)
    return out


def nearest(v: np.ndarray, to_pivots: np.ndarray, centres: np.ndarray, centre_to_pivots: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, ties to the smaller; exact squared distance) of each vector."""
    low = lower_bounds(to_pivots, centre_to_pivots, pairs)
    low2 = low * low * (1 - MARGIN)
    best = np.argmin(low, axis=1)
    dist = squared(v, centres[best])
    first = best.copy()
    for c in range(len(centres)):
        rows = np.flatnonzero((first != c) & (low2[:, c] <= dist))
        if not len(rows):
            continue
        d = squared(v[rows], centres[c])
        better = (d < dist[rows]) | ((d == dist[rows]) & (c < best[rows]))
        best[rows[better]], dist[rows[better]] = c, d[better]
    return best, dist


def _with_pivots(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            v = _matrix(b.column("v"), dim, np.int64)
            d = np.sqrt(np.stack([squared(v, p) for p in pivots], axis=1).astype(float)) if len(v) else np.zeros((0, len(pivots)))
            flat = pa.array(d.ravel())
            yield b.append_column("to_pivots", pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(pivots), dtype=np.int32)), flat))
    return run


def _assigned(b: pa.RecordBatch, dim: int, round_) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pivots, pairs, centres = round_
    v = _matrix(b.column("v"), dim, np.int64)
    between = np.sqrt(np.stack([squared(centres, p) for p in pivots], axis=1).astype(float))
    return v, *nearest(v, _matrix(b.column("to_pivots"), len(pivots), float), centres, between, pairs)


def _sums(shared, dim: int):
    """Count and exact component sums of each centroid's vectors in a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value[2]
        count, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), dim), np.int64)
        for b in batches:
            v, cluster, _ = _assigned(b, dim, shared.value)
            count += np.bincount(cluster, minlength=len(centres))
            np.add.at(total, cluster, v)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some]),
                                          "sums": pa.array(list(total[some]), pa.list_(pa.int64()))})
    return run


def _labels(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, cluster, dist = _assigned(b, dim, shared.value)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(dist)})
    return run


SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    fits = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(LIMIT) / SCALE))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")) \
        .filter(F.col("e").isNotNull() & (F.size("e") == dim)).filter(fits) \
        .select("vec_id", F.transform("e", lambda c: F.floor(c * F.lit(float(SCALE))).cast("int")).alias("v"))
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    start = [np.array(r.v, np.int64) for r in rows.orderBy(F.sha2(name.cast("binary"), 256), "v").limit(max(POOL, k)).select("v").collect()]
    if not start:
        return spark.createDataFrame([], SCHEMA)
    pivots = pivots_of(start)
    pairs = pairs_of(pivots)
    kept = written(map_arrow(rows, _with_pivots(spark.sparkContext.broadcast(pivots), dim), "vec_id long, v array<int>, to_pivots array<double>"), "clustering")
    centres = np.array(start[:k])
    for _ in range(rounds):
        part = map_arrow(kept, _sums(spark.sparkContext.broadcast((pivots, pairs, centres)), dim), "cluster int, n long, sums array<long>")
        exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
        centres = centres.copy()
        for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
            centres[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
    out = saved(map_arrow(kept, _labels(spark.sparkContext.broadcast((pivots, pairs, centres)), dim), "vec_id long, cluster int, distance long"))
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # a row a centroid
    whole = sum(int(r.own) for r in sums)
    fit = lambda x: x if x < 1 << 63 else None
    notes = spark.createDataFrame(
        [(r.cluster, fit(int(r.own)), fit(whole), hashlib.sha256(",".join(map(str, centres[r.cluster].tolist())).encode()).hexdigest()) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(notes), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
