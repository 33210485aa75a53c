"""Chunked scans and bucketed ranks equal the plain window / NumPy results."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ensemble.functions.hashing import hash_uniform
from ensemble.operators.ranking import exact_quantiles, global_rank, ordered_scan


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(3):
        n = [400, 37, 1][g]  # one hot group, one small, one single row
        for i in range(n):
            rows.append((g, float(rng.integers(0, 200)), i, float(rng.normal())))
    return spark.createDataFrame(rows, "g long, t double, id long, v double")


def test_ordered_scan_matches_plain_window(series):
    got = ordered_scan(series, ["g"], ["t", "id"], index_col="k", running_sums={"cs": "v"},
                       previous={"pv": "v"}, rows_per_chunk=25)
    w = Window.partitionBy("g").orderBy("t", "id")
    ref = series.select("g", "id", (F.row_number().over(w) - 1).alias("k"),
                        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs"),
                        F.lag("v").over(w).alias("pv"))
    a = {(r.g, r.id): r for r in got.collect()}
    b = {(r.g, r.id): r for r in ref.collect()}
    assert a.keys() == b.keys()
    for key, r in b.items():
        assert a[key].k == r.k
        assert a[key].cs == pytest.approx(r.cs, abs=1e-9)
        assert (a[key].pv is None and r.pv is None) or a[key].pv == r.pv


@pytest.mark.parametrize("rows_per_chunk", [100, 1_000_000])
def test_global_rank_is_a_permutation(spark, rows_per_chunk):
    df = spark.range(3000).select((F.col("id") % 2).alias("p"), "id",
                                  hash_uniform(7, F.col("id")).alias("h"))
    rows = global_rank(df, "h", ["id"], partition_cols=["p"], rank_col="r", rows_per_chunk=rows_per_chunk).collect()
    for p in (0, 1):
        sub = sorted((x.h, x.id, x.r) for x in rows if x.p == p)
        assert [x[2] for x in sub] == list(range(len(sub)))


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_exact_quantiles_match_numpy(series, monkeypatch, accuracy):
    monkeypatch.setattr("ensemble.operators.ranking.ACCURACY", accuracy)
    q = exact_quantiles(series, ["g"], "v", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()
    data = {}
    for r in series.collect():
        data.setdefault(r.g, []).append(r.v)
    assert len(q) == 15
    for r in q:
        assert r.value == pytest.approx(np.percentile(data[r.g], r.q * 100), abs=1e-12)


def _plain(rows):
    """Index, running sum and previous value by group, in plain Python (NULLs first)."""
    out, groups = {}, {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for rs in groups.values():
        total, last = None, None
        for k, r in enumerate(sorted(rs, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))):
            if r[3] is not None:
                total = r[3] if total is None else total + r[3]
            out[r[2]] = (k, total, last)
            last = r[3]
    return out


@pytest.mark.parametrize("rows_per_chunk", [2, 7, 1_000_000])
def test_nulls_bunched_and_equal_times(spark, rows_per_chunk):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        g = [None, 1, 2][i % 3]
        t = None if i % 11 == 0 else 5.0 if i % 4 else float(rng.integers(0, 1000)) * (1e6 if i == 100 else 1)
        rows.append((g, t, i, None if i % 5 == 0 or (g == 2 and i < 300) else float(rng.integers(-9, 9))))
    df = spark.createDataFrame(rows, "g long, t double, id long, v double")
    got = ordered_scan(df, ["g"], ["t", "id"], index_col="k", running_sums={"cs": "v"}, previous={"pv": "v"},
                       rows_per_chunk=rows_per_chunk)
    assert {r.id: (r.k, r.cs, r.pv) for r in got.collect()} == _plain(rows)
    ranks = global_rank(df, "t", ["id"], partition_cols=["g"], rank_col="r", rows_per_chunk=rows_per_chunk)
    assert {r.id: r.r for r in ranks.collect()} == {i: k for i, (k, _, _) in _plain(rows).items()}
