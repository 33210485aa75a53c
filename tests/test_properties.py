"""Property tests (hypothesis): lookups and ranks against brute force."""
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ensemble.functions.interp import interp
from ensemble.operators.ranking import exact_quantiles, global_rank, ordered_scan

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
finite = st.floats(min_value=-1e4, max_value=1e4, allow_nan=False, allow_infinity=False)


@SETTINGS
@given(nodes=st.lists(finite, min_size=2, max_size=12, unique=True),
       ys=st.lists(finite, min_size=12, max_size=12),
       xs=st.lists(finite, min_size=1, max_size=40))
def test_interp_equals_numpy(spark, nodes, ys, xs):
    nodes = sorted(nodes)
    ys = ys[:len(nodes)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(interp(F.col("x"), nodes, ys)).collect()]
    assert got == list(np.interp(xs, nodes, ys))


@SETTINGS
@given(values=st.lists(st.integers(min_value=0, max_value=5), min_size=1, max_size=60))
def test_quantiles_with_ties(spark, values):
    df = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
    q = {r.q: r.value for r in exact_quantiles(df, ["g"], "v", [0.0, 0.3, 0.5, 1.0]).collect()}
    for p, v in q.items():
        assert abs(v - np.percentile(values, p * 100)) < 1e-9


@SETTINGS
@given(values=st.lists(st.integers(min_value=0, max_value=9), min_size=1, max_size=60),
       rows_per_chunk=st.sampled_from([2, 1_000_000]))
def test_global_rank_total_order(spark, values, rows_per_chunk):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    got = {r.id: r.r for r in global_rank(df, "v", ["id"], rank_col="r", rows_per_chunk=rows_per_chunk).collect()}
    expected = {i: k for k, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert got == expected


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(-5, 5)), min_size=1, max_size=80),
       chunk=st.sampled_from([1, 2, 5, 1000]))
def test_ordered_scan_equals_brute_force(spark, rows, chunk):
    data = [(g, float(t), i, float(v)) for i, (g, t, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "g long, t double, id long, v double")
    got = {r.id: r for r in ordered_scan(df, ["g"], ["t", "id"], index_col="k", running_sums={"cs": "v"},
                                         previous={"pv": "v"}, rows_per_chunk=chunk).collect()}
    for g in {r[0] for r in data}:
        seq = sorted((r for r in data if r[0] == g), key=lambda r: (r[1], r[2]))
        total, prev = 0.0, None
        for k, (_, _, i, v) in enumerate(seq):
            total += v
            assert got[i].k == k and got[i].cs == total and got[i].pv == prev
            prev = v


@SETTINGS
@given(cols=st.lists(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=12, max_size=12),
                     min_size=2, max_size=3))
def test_correlation_pairwise_complete_matches_pandas(spark, cols):
    import math

    import pandas as pd
    from ensemble.operators.explore import correlation_matrix
    names = [f"c{i}" for i in range(len(cols))]
    rows = [tuple(None if c[r] is None else float(c[r]) for c in cols) for r in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = {(r.col_a, r.col_b): r.corr for r in correlation_matrix(df, names).collect()}
    ref = pd.DataFrame(rows, columns=names, dtype="float64").corr()
    for a in names:
        for b in names:
            e = ref.loc[a, b]
            if math.isnan(e):
                assert got[(a, b)] is None, (a, b)
            else:
                assert got[(a, b)] is not None and abs(got[(a, b)] - e) < 1e-9, (a, b, got[(a, b)], e)


@SETTINGS
@given(values=st.lists(st.floats(min_value=-50, max_value=50, allow_nan=False).map(lambda v: round(v, 1)),
                       min_size=1, max_size=60),
       bins=st.sampled_from([1, 3, 7, 20, 40]))
def test_histogram_matches_numpy(spark, values, bins):
    from ensemble.operators.explore import histogram
    df = spark.createDataFrame([(1, v) for v in values], "g int, x double")
    got = sorted(histogram(df, ["g"], "x", bins).collect(), key=lambda r: r.bin)
    counts, edges = np.histogram(values, bins=bins)
    assert [r["count"] for r in got] == list(counts)
    assert [r.lo for r in got] == list(edges[:-1])


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(-20, 20))), min_size=1, max_size=60))
def test_median_by_step_matches_pandas(spark, rows):
    import pandas as pd
    from ensemble.operators.explore import median_by_step
    data = [("r", i, step, None if v is None else float(v)) for i, (step, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "reservoir_id string, sim_id long, step long, x double")
    got = {r.step: r.x for r in median_by_step(df, ["x"]).collect()}
    ref = pd.DataFrame(data, columns=["reservoir_id", "sim_id", "step", "x"]).groupby("step")["x"].median()
    for step, e in ref.items():
        if pd.isna(e):
            assert got.get(step) is None
        else:
            assert got[step] == e
