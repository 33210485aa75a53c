import numpy as np
import pytest

from ensemble.llm import whitening as W
from ensemble.llm.common import table
from conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, n long, part long, v string, sums int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 5, 1, "v", 2) for i, v in rows], SCHEMA)


def brute(rows, components=32):
    """(n, exact deviations by row, eigenvalue shares, x - mean, covariance) by plain numpy."""
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    dev = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s)) for r in x]
    c = x - 1_000_000 - (s - n * 1_000_000) / n
    cov = c.T @ c / n
    e = np.linalg.eigvalsh(cov)[::-1][:components]
    return n, dev, e / np.trace(cov), c, cov


def check(got, rows, components=32):
    n, dev, share, c, cov = brute(rows, components)
    k = len(share)
    assert len(got) == len(rows) * k
    assert {r.n for r in got} == {n}
    by = sorted((r.vec_id is not None, r.vec_id or 0, r.deviation) for r in got if r.component == 1)
    assert by == sorted((i is not None, i or 0, d) for (i, _), d in zip(rows, dev))
    for r in got:
        assert abs(r.explained - max(0, share[r.component - 1])) <= 1e-9
        assert r.identity_error <= 1e-4 and (r.whitened is None) == (share[r.component - 1] <= W.NONE)
    return n, share, c, cov


@pytest.mark.parametrize("block", [8192, 7])
def test_components_equal_plain_eigenvectors(spark, monkeypatch, block):
    monkeypatch.setattr(W, "BLOCK", block)
    monkeypatch.setattr(W, "FAN", 2)
    r = np.random.default_rng(3)
    rows = [(i, (r.standard_normal(6) * [1, 2, 3, 4, 5, 6]).tolist()) for i in range(90)]
    got = W.whiten(frame(spark, rows).repartition(5)).collect()
    n, share, c, cov = check(got, rows)
    w = np.zeros((n, 6))
    for x in got:
        w[x.vec_id, x.component - 1] = x.whitened
    e, q = np.linalg.eigh(cov)
    want = c @ q[:, ::-1] / np.sqrt(e[::-1])
    sign = np.sign((want * w).sum(axis=0))
    assert np.abs(w * sign - want).max() < 1e-9
    assert np.abs(w.T @ w / n - np.eye(6)).max() < 1e-9


def test_whole_table(spark):
    df = table(spark, SF_SMALL, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = W.whiten(df).collect()
    check(got, rows)
    assert {r.component for r in got} == set(range(1, 33))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1, None]), (4, [nan, 1]), (5, [inf, 1]), (6, [1, 2, 3]), (7, [1e30, 0])]
    rows = [(None, [1, 2]), (8, [2, 3]), (8, [2, 3]), (9, [-1, 4]), (10, [0.5, -2])]
    check(W.whiten(frame(spark, bad + rows)).collect(), rows)
    flat = [(i, [i, 2 * i, 7]) for i in range(5)]  # one direction only
    got = W.whiten(frame(spark, flat)).collect()
    check(got, flat)
    assert [sum(r.whitened is not None for r in got if r.component == k) for k in (1, 2, 3)] == [5, 0, 0]
    one = W.whiten(frame(spark, [(1, [1, 2])])).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(None, 0.0, 0.0, 0)] * 2
    assert W.whiten(frame(spark, [])).collect() == [] == W.whiten(frame(spark, bad[:5])).collect()


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 40], [-(1 << 40)]])
    assert W._deviation(x, 2, [0]) == [None, None]
    assert W._deviation(np.array([[3], [5]]), 2, [8]) == [4, 4]


@pytest.mark.parametrize("seed", range(30))
def test_rank_one_updates_keep_the_spectrum(seed):
    r = np.random.default_rng(seed)
    n, dim = int(r.integers(1, 120)), int(r.integers(1, 12))
    x = [np.eye(dim)[r.integers(0, dim, n)], r.integers(0, 2, (n, dim)).astype(float), r.standard_normal((n, dim)) * 10.0 ** r.integers(-3, 4, dim),
         np.tile(r.integers(0, 9, dim), (n, 1)).astype(float)][seed % 4]
    parts = [p for p in np.array_split(x, 3) if len(p)]
    whole = W.Spectrum(dim)
    for p in parts:
        s = W.Spectrum(dim)
        s.add(p)
        whole.combine(s)
    c = x - x.mean(axis=0)
    want = c.T @ c
    scale = max(1e-300, np.abs(want).max())
    assert np.abs(whole.vectors @ np.diag(whole.values) @ whole.vectors.T - want).max() <= 1e-11 * scale
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(dim)).max() <= 1e-12
    assert whole.n == n and np.allclose(whole.mean, x.mean(axis=0))
