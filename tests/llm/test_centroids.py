import hashlib

import numpy as np
import pytest

from ensemble.llm import centroids as C
from ensemble.llm.queries import ORACLE, REGISTRY
from conftest import SF_SMALL
from oracle_compare import compare, duck

SCHEMA = "vec_id long, embedding array<float>, cluster int, to_pivots string, v long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 9, "x", 1) for i, v in rows], SCHEMA)


def brute(rows, k=8, rounds=10):
    ints = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(ints, key=lambda r: (name(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    give = lambda: [min((dist(v, c), j) for j, c in enumerate(centres)) for _, v in ints]
    for _ in range(rounds):
        near = give()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(ints, near) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    near = give()
    total = sum(d for d, _ in near)
    return sorted((str(i), j, d, sum(e for e, c in near if c == j), total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
                  for (i, _), (d, j) in zip(ints, near))


def rows_of(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_query_equals_sql(spark):
    ok, note = compare(REGISTRY["op12_centroids"](spark, SF_SMALL), duck(SF_SMALL), ORACLE["op12_centroids"])
    assert ok, note


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    middle = r.integers(-2, 3, (4, 5))
    rows = [(int(i), (middle[i % 4] + r.integers(-2, 3, 5) * [0.25, 0.001][seed % 2]).tolist()) for i in range(120)]
    assert rows_of(C.cluster_vectors(frame(spark, rows).repartition(6), k=6, rounds=4, dim=5)) == brute(rows, 6, 4)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1, None]), (4, [nan, 1]), (5, [inf, 1]), (6, [1, 2, 3]), (7, [1e9, 0])]
    rows = [(None, [1, 2]), (8, [2, 3]), (8, [2, 3]), (8, [0, 0]), (9, [-1, 4]), (10, [-0.0001, 0.0001])]
    for k in (3, 8):
        assert rows_of(C.cluster_vectors(frame(spark, bad + rows), k=k, rounds=3, dim=2)) == brute(rows, k, 3)
    same = [(i, [1, 1]) for i in range(12)]  # no two pivots, all ties
    assert rows_of(C.cluster_vectors(frame(spark, same), k=4, rounds=2, dim=2)) == brute(same, 4, 2)
    assert C.cluster_vectors(frame(spark, [])).collect() == [] == C.cluster_vectors(frame(spark, bad), dim=2).collect()


def test_bounds_never_exceed_the_distance_and_prune():
    r = np.random.default_rng(1)
    middle = r.integers(-900, 900, (5, 16))
    v = middle[r.integers(0, 5, 3000)] + r.integers(-9, 10, (3000, 16))
    pivots = C.pivots_of(list(v[:64]))
    pairs = C.pairs_of(pivots)
    to = lambda x: np.sqrt(np.stack([C.squared(x, p) for p in pivots], axis=1).astype(float))
    low = C.lower_bounds(to(v), to(middle), pairs)
    exact = np.stack([C.squared(v, c) for c in middle], axis=1)
    assert (low * low * (1 - C.MARGIN) <= exact).all()
    best, dist = C.nearest(v, to(v), middle, to(middle), pairs)
    assert (dist == exact.min(axis=1)).all() and (best == exact.argmin(axis=1)).all()
    assert ((low * low * (1 - C.MARGIN)) > dist[:, None]).mean() > 0.3
