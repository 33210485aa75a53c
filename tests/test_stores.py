import os

import pytest
from pyspark.sql import functions as F

from ensemble.plans import datasets as D
from ensemble.sources import stores


@pytest.fixture
def rows(spark):
    return spark.range(1000).select(F.concat(F.lit("r"), F.col("id") % 3).alias("reservoir_id"), (F.col("id") * 7919 % 1000).alias("sim_id"), F.col("id").alias("v"))


def test_ordered_store(spark, rows, tmp_path):
    path, keys = str(tmp_path / "o"), ["reservoir_id", "sim_id"]
    man = stores.write_ordered(rows, path, keys, 7).orderBy("file_no").collect()
    assert 3 <= len(man) <= 7 and all(m.rising for m in man) and sum(m["rows"] for m in man) == 1000
    assert all(tuple(a["last"]) < tuple(b["first"]) for a, b in zip(man, man[1:]))
    want = sorted((r.reservoir_id, r.sim_id, r.v) for r in rows.collect())
    got = stores.read_ordered(spark, path)
    assert [(r.reservoir_id, r.sim_id, r.v) for r in sorted(got.collect(), key=lambda r: r.position)] == want
    plan = got._jdf.queryExecution().toString()
    assert "Sort" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert [tuple(r) for r in stores.head(spark, path, keys, 5)] == want[:5]
    part = stores.read_key_range(spark, path, keys, ("r1", 100), ("r1", 300))
    assert sorted(map(tuple, part.collect())) == [w for w in want if ("r1", 100) <= w[:2] <= ("r1", 300)]
    assert len(part.inputFiles()) < len(man)
    assert [tuple(r) for r in stores.iterate(spark, path, keys)] == want


def test_ordered_store_of_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "none")
    assert stores.write_ordered(rows.limit(0), path, ["reservoir_id", "sim_id"], 3).count() == 0
    assert stores.read_ordered(spark, path).count() == 0 and stores.head(spark, path, ["sim_id"]) == []


def test_batches_add_repeat_and_notice_changes(spark, rows, tmp_path):
    path = str(tmp_path / "b")
    one, two = rows.where("v < 500"), rows.where("v >= 500")
    assert stores.write_batch(spark, path, "1", "s1", lambda: one)
    assert stores.write_batch(spark, path, "2", "s1", lambda: two)
    count = lambda: {r.batch: r["count"] for r in stores.read_batches(spark, path).groupBy(F.col("batch").cast("string").alias("batch")).count().collect()}
    assert count() == {"1": 500, "2": 500}

    def fail():
        raise AssertionError("a batch of the same sources is not built again")
    assert not stores.write_batch(spark, path, "1", "s1", fail)
    # a changed source: the batch is replaced, a reservoir that it lost goes, the other batch stays
    assert stores.write_batch(spark, path, "1", "s2", lambda: one.where("reservoir_id <> 'r0' and v < 100"))
    assert count() == {"1": one.where("reservoir_id <> 'r0' and v < 100").count(), "2": 500}
    assert stores.batches(spark, path) == {"1": "s2", "2": "s1"}
    assert stores.read_batches(spark, path).where("batch = '1' and reservoir_id = 'r0'").count() == 0


def test_fingerprint_and_materialized_tables_follow_the_source(spark, rows, tmp_path):
    src = str(tmp_path / "sf")
    rows.write.parquet(f"{src}/events.parquet")
    a = stores.fingerprint(spark, f"{src}/events.parquet")
    assert a == stores.fingerprint(spark, f"{src}/events.parquet")
    build = lambda: spark.read.parquet(f"{src}/events.parquet")
    first = D.materialize(spark, src, "t", build)
    assert D.materialize(spark, src, "t", build) == first
    rows.union(rows).write.mode("overwrite").parquet(f"{src}/events.parquet")
    assert stores.fingerprint(spark, f"{src}/events.parquet") != a
    assert D.materialized(spark, src, "t", build).count() == 2000
    assert not os.path.exists(f"{src}/none") and stores.fingerprint(spark, f"{src}/none") == stores.fingerprint(spark)
