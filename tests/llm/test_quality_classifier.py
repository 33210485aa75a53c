import numpy as np
import pyarrow as pa

from brute import crc, documents, frame
from conftest import SF_SMALL
from ensemble.llm import quality as Q
from ensemble.llm.common import table


def test_held_out_accuracy(spark):
    d = SF_SMALL.replace("0.001", "0.01")
    got = Q.score_documents(table(spark, d, "documents"), table(spark, d, "labels")).toPandas()
    both = got.merge(table(spark, d, "labels").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert len(got) == 1000 and (got.held_out == [crc(i, 3) == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (held.predicted == held.quality).mean() > 0.95


def plain_isotonic(y, w):
    """Largest of the smallest means: the fit's textbook formula, without pooling."""
    mean = lambda a, z: float(np.average(y[a:z], weights=w[a:z]))
    return np.array([max(min(mean(a, z) for z in range(i + 1, len(y) + 1)) for a in range(i + 1)) for i in range(len(y))])


def test_scores_equal_plain_regression(spark):
    """Features by their formula, ridge as least squares with rows added, calibration by the textbook formula."""
    docs, labels = (table(spark, SF_SMALL, t) for t in ("documents", "labels"))
    got = Q.score_documents(docs, labels).toPandas().sort_values("doc_id").score.to_numpy()
    rows = docs.select("doc_id", "text").toPandas().sort_values("doc_id")
    stats = Q.statistics(pa.array(rows.text.tolist(), pa.string()))
    mark = {r.doc_id: float(r.quality) for r in labels.collect() if crc(r.doc_id, 3) != 1}
    train = np.array([i for i, d in enumerate(rows.doc_id) if d in mark])
    y = np.array([mark[d] for d in rows.doc_id.iloc[train]])
    assert len(train) > 50 and 0 < y.mean() < 1

    centre, scale = stats[train].mean(axis=0), stats[train].std(axis=0)
    x = np.clip((stats - centre) / np.where(scale > 1e-9, scale, 1.0), -6, 6)
    rng = np.random.default_rng(7)
    direction, phase = rng.standard_normal((x.shape[1], Q.N_RANDOM)) / Q.WIDTH, rng.uniform(0, 2 * np.pi, Q.N_RANDOM)
    z = np.column_stack([np.cos(x @ direction + phase) * (2 / Q.N_RANDOM) ** 0.5, np.ones(len(x))])
    more = np.sqrt(Q.RIDGE * len(train)) * np.eye(z.shape[1])
    weights = np.linalg.lstsq(np.vstack([z[train], more]), np.concatenate([y, np.zeros(len(more))]), rcond=None)[0]

    raw = z @ weights
    inside = np.clip(raw[train], Q.LOW, Q.HIGH)
    bins = np.minimum((inside - Q.LOW) / (Q.HIGH - Q.LOW) * Q.BINS, Q.BINS - 1).astype(int)
    knots, mean, n = (np.array(v) for v in zip(*[(inside[bins == b].mean(), y[bins == b].mean(), (bins == b).sum()) for b in np.unique(bins)]))
    want = np.clip(np.interp(raw, knots, plain_isotonic(mean, n)), 0, 1)
    assert np.allclose(got, want, atol=1e-6)


def test_awkward_rows(spark):
    rows = documents()
    docs = frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.score_documents(docs, none).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 0), (None, 1, 1), (5, 0, 0), (999, 1, 0)], none.schema)
    assert all(0 <= r.score <= 1 for r in Q.score_documents(docs, odd).collect())
    kept = Q.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert Q.score_documents(frame(spark, []), odd).collect() == []


def test_isotonic_and_statistics():
    y = np.array([0.1, 0.5, 0.3, 0.2, 0.9])
    fit = Q.isotonic(np.arange(5.0), y, np.array([1.0, 1, 2, 1, 1]))
    assert (np.diff(fit) >= 0).all() and abs(fit[1:4].mean() - (0.5 + 0.6 + 0.2) / 4) < 1e-12
    texts = ["", None, "Ab cd", "x" * (3 << 20), "a b " * 400_000]
    both = Q.statistics(pa.array(texts, pa.string()))
    assert (both[:2] == 0).all() and np.isfinite(both).all()
    for i, t in enumerate(texts):  # a text's statistics don't depend on its neighbours
        assert np.allclose(Q.statistics(pa.array([t], pa.string())), both[i])
