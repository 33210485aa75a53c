"""Approximate nearest neighbours by stable projections and kd-trees (operator 6).

Vectors are scaled to length one and projected to ``M`` dimensions by a Gaussian
(2-stable) matrix: the squared projected distance of two vectors is their
squared distance times a chi-square variable of M degrees. A coarse kd-tree,
whose splits come from a bounded sample, deals all projected vectors into
cells; each cell (cut into blocks of bounded size) has its own kd-tree. A query
walks a tree's leaves by growing projected distance (one, then twice as many at a
time), verifies the vectors there by exact cosine, and stops when the chi-square
test says that a vector beyond would be nearer than the worst of its best found
with a probability below 1 - CONFIDENCE. It searches its own cell first, then all other cells that the
same test does not rule out.

Equal vectors are folded first; as the nearest few are asked for, the smallest
few ids of each class are enough.

Defined cases: vectors that are null, zero, or hold a null or non-finite
component take no part, nor do null ids and vectors of another length than most
(the shortest of equally frequent lengths); a repeated row counts once; a vec_id
given with several vectors is a query with each, and never its own neighbour;
fewer candidates than asked for are all returned; an empty table gives no rows;
other columns are ignored. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, saved
from .similar import runs

M, CONFIDENCE = 8, 0.97
#: Vectors in a block, in a leaf of its tree; sampled vectors for each cell of the coarse tree, and in all.
BLOCK, LEAF, PER_CELL, SAMPLE = 8192, 48, 64, 2_000_000
#: Queries that meet a block in one task.
VISITS = 20_000


def chi_square_bound(p: float, m: int = M) -> float:
    """The p-quantile of chi-square with an even number m of degrees."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return hi


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((dim, M))


class KdTree:
    """kd-tree over projected points; ``tight`` boxes hold the given points, else whole regions."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool = True):
        m = points.shape[1]
        self.dim, self.split, self.left, self.right, self.rows = [], [], [], [], []
        self.low, self.high = [], []
        stack = [(np.arange(len(points)), np.full(m, -np.inf), np.full(m, np.inf), -1, 0)]
        while stack:
            rows, lo, hi, parent, side = stack.pop()
            node = len(self.dim)
            if parent >= 0:
                (self.left if side == 0 else self.right)[parent] = node
            p = points[rows]
            if tight and len(rows):
                lo, hi = p.min(axis=0), p.max(axis=0)
            self.dim.append(-1)
            self.split.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.rows.append(rows)
            self.low.append(lo)
            self.high.append(hi)
            if len(rows) <= leaf:
                continue
            d = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            cut = float(np.partition(p[:, d], (len(rows) - 1) // 2)[(len(rows) - 1) // 2])
            up = p[:, d] > cut
            if not up.any():  # equal values from the middle on: no split here
                continue
            self.dim[node], self.split[node], self.rows[node] = d, cut, None
            lo2, hi2 = lo.copy(), hi.copy()
            hi2[d] = lo2[d] = cut
            stack.append((rows[up], lo2, hi, node, 1))
            stack.append((rows[~up], lo, hi2, node, 0))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.leaf_nodes = np.flatnonzero(np.array(self.dim) < 0)
        self.leaf_low, self.leaf_high = self.low[self.leaf_nodes], self.high[self.leaf_nodes]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        dim, split, left, right = map(np.array, (self.dim, self.split, self.left, self.right))
        node = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(dim[node] >= 0)).size:
            n = node[inner]
            up = points[inner, dim[n]] > split[n]
            node[inner] = np.where(up, right[n], left[n])
        return node

    def box(self, node: int, q: np.ndarray) -> float:
        out = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0)
        return float(out @ out)

    def by_distance(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared projected distances, nodes) of all leaves by growing distance; for trees of few leaves."""
        out = np.maximum(np.maximum(self.leaf_low - q, q - self.leaf_high), 0)
        d = np.einsum("ij,ij->i", out, out)
        order = np.argsort(d, kind="stable")
        return d[order], self.leaf_nodes[order]

    def leaves(self, q: np.ndarray) -> Iterator[tuple[float, int]]:
        """(squared projected distance, leaf) by growing distance."""
        heap = [(self.box(0, q), 0)]
        while heap:
            d, node = heapq.heappop(heap)
            if self.dim[node] < 0:
                yield d, node
            else:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (self.box(child, q), child))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _deal(tree, dim: int):
    """Adds the cell of each vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = projection(dim)
        for b in batches:
            cell = tree.value.leaf_of(_unit(_matrix(b.column("v"), dim)) @ g)
            yield b.append_column("cell", pa.array(cell.astype(np.int32)))
    return run


def _search(dim: int, k: int):
    """Rows of a block: its vectors (kind 0), then the queries (kind 1) with the worst distance to beat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, limit = projection(dim), chi_square_bound(CONFIDENCE)
        for t in runs(batches, ["cell", "salt", "part"]):
            kind, smallest = t.column("kind").to_numpy(), t.column("first").to_numpy()
            v, ids, best = _matrix(t.column("v").combine_chunks(), dim), t.column("cls").to_numpy(), t.column("worst").to_numpy()
            points, asked = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            if not len(points) or not len(asked):
                continue
            own, norm, smallest = v[points], np.linalg.norm(v[points], axis=1), smallest[points]
            low = (own / norm[:, None]) @ g
            tree = KdTree(low, LEAF)
            out_q, out_c, out_s = [], [], []
            for i in asked:
                q = v[i]
                size = np.linalg.norm(q)
                at = (q / size) @ g
                worst, found, score = float(best[i]), np.zeros(0, np.int64), np.zeros(0)
                far, leaves = tree.by_distance(at)
                seen, many = 0, 1
                while len(step := leaves[seen : min(seen + many, int(np.searchsorted(far, limit * worst, side="right")))]):
                    seen, many = seen + len(step), 2 * many
                    rows = np.concatenate([tree.rows[leaf] for leaf in step])
                    gap = low[rows] - at
                    rows = rows[np.einsum("ij,ij->i", gap, gap) <= limit * worst]
                    if not len(rows):
                        continue
                    found = np.concatenate([found, rows])
                    # row by row, so that a score depends on its two vectors alone
                    score = np.concatenate([score, np.einsum("ij,j->i", own[rows], q) / (norm[rows] * size)])
                    if len(found) > 8 * k:
                        keep = np.lexsort((smallest[found], -score))[:k]
                        found, score = found[keep], score[keep]
                    if len(found) >= k:  # squared distance of unit vectors: 2 - 2 cos
                        worst = min(worst, 2 - 2 * float(np.partition(score, len(score) - k)[len(score) - k]) + 1e-12)
                keep = np.lexsort((smallest[found], -score))[:k]  # of equal scores those with the smallest ids
                out_q += [ids[i]] * len(keep)
                out_c += ids[points][found[keep]].tolist()
                out_s += score[keep].tolist()
            yield pa.RecordBatch.from_pydict({"query": pa.array(out_q, pa.int64()), "cls": pa.array(out_c, pa.int64()),
                                              "score": pa.array(out_s, pa.float64())})
    return run


def _other_cells(tree, dim: int):
    """The other cells that the stopping test leaves to each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, limit = projection(dim), chi_square_bound(CONFIDENCE)
        for b in batches:
            low, cell, worst = _unit(_matrix(b.column("v"), dim)) @ g, b.column("cell").to_numpy(), b.column("worst").to_numpy()
            row, to = [], []
            for i in range(b.num_rows):
                for d, leaf in tree.value.leaves(low[i]):
                    if d > limit * worst[i]:
                        break
                    if leaf != cell[i]:
                        row.append(i)
                        to.append(leaf)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("cls").take(at), b.column("v").take(at), pa.array(to, pa.int32()),
                                              b.column("worst").take(at)], names=["cls", "v", "cell", "worst"])
    return run


def _visit(points: DataFrame, visits: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, cls, score) of what the visits (cls, v, cell, worst) find in their cells' blocks."""
    n = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = visits.groupBy("cell").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts"))
    salts = points.groupBy("cell").agg(F.max("salts").alias("salts"))
    own = points.join(parts, "cell").select("cell", "salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                           F.lit(0).alias("kind"), "cls", "v", F.lit(0.0).alias("worst"), "first")
    asked = visits.join(parts, "cell").join(salts, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "cls", "v", "worst", F.lit(0).cast("long").alias("first"))
    both = own.union(asked).repartition(n, "cell", "salt", "part").sortWithinPartitions("cell", "salt", "part", "kind")
    return map_arrow(both, _search(dim, k), "query long, cls long, score double")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")) \
        .filter("vec_id is not null and v is not null") \
        .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common.n
    rows = rows.filter(F.size("v") == dim).distinct()

    # equal vectors are one class, with its k + 1 smallest ids
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = saved(rows.withColumn("no", first).filter(F.col("no") <= k + 1).groupBy("v")
                    .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                    .withColumn("cls", F.xxhash64("v", F.col("ids")[0])))
    total = classes.count()
    cells = 1 << max(0, math.ceil(math.log2(max(1, total / BLOCK))))
    wanted = min(SAMPLE, cells * PER_CELL)
    order = F.xxhash64("cls", F.lit(5))
    picked = [r.v for r in classes.filter(F.pmod(order, F.lit(1 << 20)) < math.ceil(min(1.0, 2.0 * wanted / total) * (1 << 20)))
              .select("v").limit(2 * wanted + 100).collect()]
    low = _unit(np.array(picked)) @ projection(dim) if picked else np.zeros((0, M))
    tree = spark.sparkContext.broadcast(KdTree(low, max(1, len(low) // cells), tight=False))
    dealt = saved(map_arrow(classes.select("cls", "v", F.col("ids")[0].alias("first")), _deal(tree, dim),
                            "cls long, v array<double>, first long, cell int"))
    salts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    points = dealt.join(salts, "cell").withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("salts")).cast("int"))

    queries = rows.filter(F.col("vec_id") % every == 0)
    asked = saved(queries.select("v").distinct().join(classes.select("v", "cls"), "v").join(dealt.select("cls", "cell"), "cls"))
    near = saved(_visit(points, asked.withColumn("worst", F.lit(4.0)), dim, k + 1))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))
    worst = near.withColumn("no", rank).filter(F.col("no") <= k + 1).groupBy("query") \
        .agg(F.when(F.count("*") > k, 2 - 2 * F.min("score") + 1e-12).otherwise(4.0).alias("worst"))
    visits = map_arrow(asked.join(worst, asked.cls == worst.query).select("cls", "v", "cell", "worst"),
                       _other_cells(tree, dim), "cls long, v array<double>, cell int, worst double")
    far = _visit(points, saved(visits), dim, k + 1)
    # of equal scores, any of which may hold the smaller ids, the classes are ranked by their smallest id
    both = near.union(far).join(classes.select("cls", "ids"), "cls")
    best = both.withColumn("no", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0]))) \
        .filter(F.col("no") <= k + 1)
    found = queries.join(classes.select("v", F.col("cls").alias("query")), "v") \
        .select(F.col("vec_id").alias("query_id"), "query").join(best, "query") \
        .select("query_id", F.explode("ids").alias("vec_id"), "score").filter("query_id <> vec_id") \
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
