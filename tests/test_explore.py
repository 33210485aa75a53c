import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ensemble.operators import explore, metrics


def test_histogram_matches_numpy_and_closes_last_bin(spark):
    vals = [0.0, 1.0, 2.5, 3.0, 9.99, 10.0, 10.0]
    df = spark.createDataFrame([(1, v) for v in vals], "g int, x double")
    h = sorted(explore.histogram(df, ["g"], "x", 4).collect(), key=lambda r: r.bin)
    counts, edges = np.histogram(vals, bins=4)
    assert [r["count"] for r in h] == list(counts)
    assert [r.lo for r in h] == pytest.approx(list(edges[:-1]))
    assert h[-1].hi == 10.0


def test_histogram_constant_group_widened(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0)], "g int, x double")
    h = sorted(explore.histogram(df, ["g"], "x", 4).collect(), key=lambda r: r.bin)
    counts, edges = np.histogram([5.0, 5.0], bins=4)
    assert [r["count"] for r in h] == list(counts)
    assert h[0].lo == 4.5 and h[-1].hi == 5.5


def test_correlation_constant_column_is_null(spark):
    rows = [(float(i), 2.0 * i + 1, 7.0) for i in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = {(r.col_a, r.col_b): r.corr for r in explore.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert out[("a", "b")] == pytest.approx(1.0) and out[("b", "a")] == pytest.approx(1.0)
    assert out[("a", "c")] is None and out[("c", "c")] is None and out[("a", "a")] == pytest.approx(1.0)


def test_median_by_step_interpolates(spark):
    rows = [("r", s, k, float(v)) for s, v in enumerate([1, 2, 3, 10]) for k in (0,)]
    df = spark.createDataFrame(rows, "reservoir_id string, sim_id long, step long, x double")
    out = explore.median_by_step(df, ["x"]).first()
    assert out.x == 2.5


@pytest.mark.parametrize("ys,ps,expected", [
    ([5.0, 5.0, 5.0], [5.0, 5.0, 5.0], 1.0),   # constant y, perfect fit
    ([5.0, 5.0, 5.0], [5.0, 4.0, 5.0], 0.0),   # constant y, imperfect
    ([1.0], [1.0], None),                      # single row
    ([1.0, 2.0, 3.0], [1.0, 2.0, 4.0], 0.5),
])
def test_r2_special_cases(spark, ys, ps, expected):
    df = spark.createDataFrame(list(zip(ys, ps)), "y double, y_pred double")
    r = metrics.regression_metrics(df).first()
    assert (r.r2 is None) if expected is None else r.r2 == pytest.approx(expected)


def test_rank_picks_positions(spark):
    rows = [("r", i, float(v)) for i, v in enumerate([5, 1, 4, 2, 3])]
    df = spark.createDataFrame(rows, "reservoir_id string, sim_id long, m double")
    picks = {r.pick: r.sim_id for r in explore.rank_picks(df, "m", ("first", "half", "last", "third")).collect()}
    assert picks == {"first": 1, "half": 4, "last": 0, "third": 3}


def test_binned_2d_counts_everything(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("y"), (F.col("id") * 0.5).alias("p"))
    assert sum(r["count"] for r in explore.binned_2d(df, "y", "p", 10).collect()) == 100


def test_weighted_mean_layer_porosity(spark):
    from ensemble.schemas import RESERVOIRS
    from ensemble.sources.dimensions import layers
    r = explore.weighted_mean(layers(spark), "thickness_ft", "porosity").first()
    assert r.weighted_mean == pytest.approx(RESERVOIRS["spe9"]["baseline_porosity"])
    assert r.total_weight == 359.0 and r.weighted_mean == pytest.approx(47.091 / 359)


def test_quantile_band(spark):
    rows = [("r", s, 0, float(v)) for s, v in enumerate(range(101))]
    df = spark.createDataFrame(rows, "reservoir_id string, sim_id long, step long, p double")
    b = explore.quantile_band_by_step(df, "p").first()
    assert (b["0.05"], b["0.5"], b["0.95"]) == (5.0, 50.0, 95.0)


def test_approximate_paths_close_to_exact(spark):
    rows = [("r", s, 0, float(v)) for s, v in enumerate(range(1001))]
    df = spark.createDataFrame(rows, "reservoir_id string, sim_id long, step long, x double")
    a = explore.median_by_step(df, ["x"], exact=False).first().x
    e = explore.median_by_step(df, ["x"]).first().x
    assert e == 500.0 and abs(a - e) <= 1.0
    d = explore.describe_columns(df, ["x"], exact=False).first()
    assert abs(d.p25 - 250.0) <= 1.0 and d["count"] == 1001


@pytest.mark.parametrize("accuracy", [8, 10_000])
def test_rank_picks_without_ranking_all(spark, monkeypatch, accuracy):
    monkeypatch.setattr(explore, "ACCURACY", accuracy)
    rng = np.random.default_rng(2)
    rows = [("abc"[i % 3], i, float(rng.integers(0, 12)) if i % 3 else 4.0) for i in range(500)]  # many ties, one group of equals
    rows += [("d", 900, 1.0), ("a", 901, None)]
    df = spark.createDataFrame(rows, "reservoir_id string, sim_id long, m double")
    names = ("first", "third", "half", "two_thirds", "last")
    got = {(r.reservoir_id, r.pick): (r.m, r.sim_id) for r in explore.rank_picks(df, "m", names).collect()}
    want = {}
    for g in "abcd":
        own = sorted((m, i) for x, i, m in rows if x == g and m is not None)
        n = len(own)
        want |= {(g, p): own[k] for p, k in zip(names, (0, n // 3, n // 2, 2 * n // 3, n - 1))}
    assert got == want


def test_best_and_worst_are_limited_before_the_shuffle(spark):
    rows = [("a", i, float(i * 37 % 101)) for i in range(50)] + [("b", 1, 2.0), ("b", 2, 1.0)]
    df = spark.createDataFrame(rows, "reservoir_id string, sim_id long, m double")
    out = explore.best_and_worst(df, "m", 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
    order = sorted((m, i) for g, i, m in rows if g == "a")
    got = sorted((r.kind, r["rank"], r.sim_id) for r in out.where("reservoir_id = 'a'").collect())
    assert got == [("best", k, order[k][1]) for k in range(3)] + [("worst", k, order[k][1]) for k in (47, 48, 49)]
    assert sorted((r.kind, r["rank"], r.sim_id) for r in out.where("reservoir_id = 'b'").collect()) == [
        ("best", 0, 2), ("best", 1, 1), ("worst", 0, 2), ("worst", 1, 1)]


def test_correlation_is_lazy_and_pairwise_complete(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(None if rng.random() < 0.2 else float(x) for x in (*(rng.normal(size=3) * [1, 100, 1e6] + 1e6), 7.0)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = explore.correlation_matrix(df, ["a", "b", "c", "k"])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    got = {(r.col_a, r.col_b): r["corr"] for r in out.collect()}
    want = pd.DataFrame(rows, columns=list("abck")).astype(float).corr()
    assert len(got) == 16
    for (a, b), r in got.items():
        if "k" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], rel=1e-9)
