import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemble.operators.interval import interp_asof, segments


@pytest.mark.parametrize("rows_per_chunk", [40, 1_000_000])
def test_lookup_equals_numpy(spark, rows_per_chunk):
    rng = np.random.default_rng(4)
    tables, nodes, rows = {}, [], []
    for t in [None, *range(60)]:
        n = int(rng.integers(1, 9))
        x = np.sort(rng.choice(200, n, replace=False)) / 4.0
        y = rng.normal(size=n)
        tables[t] = (x, y)
        nodes += [(t, float(a), float(b)) for a, b in zip(x, y)]
    for i in range(1500):
        t = 0 if i % 3 == 0 else None if i % 50 == 1 else int(rng.integers(0, 60))  # one table has a third of the rows
        rows.append((t, i, None if i % 97 == 0 else float(rng.integers(-10, 220)) / 4.0))
    rows.append((999, 5000, 1.0))  # a table without nodes
    got = interp_asof(spark.createDataFrame(rows, "t long, id long, p double"), spark.createDataFrame(nodes, "t long, x double, y double"),
                      ["t"], "p", rows_per_chunk=rows_per_chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.p is None or r.t == 999:
            assert r.value is None and r.seg is None
            continue
        x, y = tables[r.t]
        assert r.value == pytest.approx(float(np.interp(r.p, x, y)), abs=1e-12)
        assert r.seg == min(max(int(np.searchsorted(x, r.p, side="right")) - 1, 0), len(x) - 2)


def test_ten_thousand_tables(spark):
    """Tables and rows from a rule: y = (table + 1) * x at the nodes 0, 10, ..., 40; a row at 7 * k."""
    tables = spark.range(10_000).withColumnRenamed("id", "t")
    nodes = tables.select("t", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("t", (F.col("k") * 10.0).alias("x"), ((F.col("t") + 1) * F.col("k") * 10.0).alias("y"))
    rows = tables.select("t", F.explode(F.sequence(F.lit(-1), F.lit(6))).alias("k")).select("t", "k", (F.col("k") * 7.0).alias("p"))
    got = interp_asof(rows, nodes, ["t"], "p")
    want = (F.col("t") + 1) * F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(40.0))
    check = got.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("value") - want) / (F.col("t") + 1)).alias("gap")).first()
    assert check.n == 80_000 and check.gap < 1e-12


def test_equal_nodes_and_no_rows(spark):
    nodes = spark.createDataFrame([(1, 2.0, 5.0), (1, 2.0, 7.0), (1, None, 1.0)], "t long, x double, y double")
    assert [tuple(r) for r in segments(nodes, ["t"]).collect()] == [(1, 0, 2.0, 7.0, None, None)]
    none = spark.createDataFrame([], "t long, p double")
    assert interp_asof(none, nodes, ["t"], "p").collect() == []
