import numpy as np
import pytest

from ensemble.llm import ann
from ensemble.llm.common import table
from conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, cls long, v string, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "v", 2) for i, v in rows], SCHEMA)


def brute(rows, k=5, every=50):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ok = list({(i, tuple(v)): (i, v) for i, v in ok}.values())
    out = {}
    for i, v in ok:
        if i % every == 0:
            s = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in ok if j != i)
            out[i] = s[:k]
    return out


def check(got, want, k=5, recall=0.9):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {q for q, w in want.items() if w}
    hit = total = 0
    for q, rows in by.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(want[q]) + 1))
        assert all(a[2] >= b[2] for a, b in zip(rows, rows[1:]))
        hit += sum(round(s, 9) >= round(-want[q][-1][0], 9) for _, _, s in rows)
        total += len(rows)
    assert hit / max(1, total) >= recall


@pytest.mark.parametrize("block", [8192, 100])
def test_recall_in_many_cells(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "VISITS", 3 if block == 100 else 20_000)
    rnd = np.random.default_rng(3)
    centre = rnd.standard_normal((20, 16))
    rows = [(i, (centre[i % 20] + rnd.standard_normal(16) * 0.5).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[7][1]) for i in range(400)]  # a hot vector
    check(ann.nearest(frame(spark, rows)).collect(), brute(rows), recall=0.95)


def test_ties_and_awkward_rows(spark):
    rows = [(0, [1, 0]), (50, [2, 0]), (100, [0, 1]), (3, [1, 1]), (2, [1, 1]), (1, [1, 1]), (4, [0, 0]), (150, None), (200, [None, 1]),
            (250, [float("nan"), 1]), (300, [float("inf"), 1]), (350, []), (400, [1, 2, 3]), (None, [1, 0]), (1, [1, 1]), (9, [-1, 0])]
    want = brute([r for r in rows if r[0] not in (350, 400)])
    got = ann.nearest(frame(spark, rows)).collect()
    check(got, want, recall=1.0)
    first = sorted((r.rank, r.vec_id) for r in got if r.query_id == 0)
    assert first[0] == (1, 50) and [v for _, v in first[1:4]] == [1, 2, 3]
    assert ann.nearest(frame(spark, [])).collect() == []
    assert ann.nearest(frame(spark, [(0, [1.0, 2.0])])).collect() == []


def test_query_recall(spark):
    e = table(spark, SF_SMALL, "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in e.collect()]
    check(ann.nearest(e).collect(), brute(rows))


def test_quantiles():
    assert abs(ann.chi_square_bound(0.95, 8) - 15.507) < 1e-2 and abs(ann.chi_square_bound(0.99, 2) - 9.210) < 1e-2


def test_ties_of_many_classes_go_to_the_smallest_ids(spark):
    """Thirty multiples of one vector have the same cosine with the query, though no two are equal."""
    rows = [(50, [1, 0.25, 0, 0])] + [(j, [2.0 ** (j - 185), 0, 0, 0]) for j in reversed(range(171, 201))] + [(300 + j, [0, 0, 1, j]) for j in range(5)]
    got = [r for r in ann.nearest(frame(spark, rows)).collect() if r.query_id == 50]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [171, 172, 173, 174, 175] and len({r.score for r in got}) == 1
