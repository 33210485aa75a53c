import numpy as np
from pyspark.sql import functions as F

from ensemble.operators import summaries as S


def test_batches_merge_to_the_whole_within_the_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("batch"), (F.col("id") % 5000).alias("sim_id"),
                                    (F.randn(4) * 10 + F.col("id") % 3).alias("x"))
    df = df.withColumn("x", F.when(F.col("sim_id") % 50 == 0, None).when(F.col("sim_id") % 50 == 1, float("nan")).otherwise(F.col("x"))).cache()
    parts = S.summarize(df, "x", ["batch", "g"])
    assert parts.count() == 21
    got = {r.g: r for r in S.quantiles(S.merge(parts, ["g"]), [0.05, 0.5, 0.95], ["a", "b", "c"]).collect()}
    rows = [r for r in df.collect() if r.x is not None and not np.isnan(r.x)]
    for g in range(3):
        x = np.array([r.x for r in rows if r.g == g])
        r = got[g]
        assert (r.n, r.lo, r.hi) == (len(x), x.min(), x.max()) and abs(r["mean"] - x.mean()) < 1e-9
        for p, v in ((0.05, r.a), (0.5, r.b), (0.95, r.c)):
            assert abs((x <= v).mean() - p) <= S.RANK_ERROR + 1 / len(x)
        assert abs(r.n_runs - len({q.sim_id for q in rows if q.g == g})) <= 0.065 * 5000
    assert S.summarize(df.where("g > 5"), "x", ["g"]).collect() == []
