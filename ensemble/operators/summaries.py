"""Mergeable summaries of a growing dataset: quantile and distinct sketches by group.

A summary table has one small row a (batch, group): count, bounds, sum, a KLL sketch
of the values and an HLL sketch of the run ids. New batches add rows; a question
merges the rows of the batches it wants, without reading their data again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a KLL sketch; the rank error of a quantile is below RANK_ERROR (of the group's rows) with 99 % confidence.
KLL_K, RANK_ERROR = 400, 0.0085
#: log2 of an HLL sketch's registers; the relative standard error of a distinct count is 1.04 / sqrt(2^12), about 1.6 %.
HLL_LG_K = 12


def summarize(df: DataFrame, value: str, group_cols: Sequence[str], run_col: str = "sim_id") -> DataFrame:
    """(group..., n, lo, hi, total, sketch, runs); NULL values are not counted, groups without one have no row."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    x = F.col(value).cast("double")
    return rows.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(x).alias("total"),
        F.kll_sketch_agg_double(x, F.lit(KLL_K)).alias("sketch"), F.hll_sketch_agg(F.col(run_col).cast("long"), F.lit(HLL_LG_K)).alias("runs"))


def merge(summaries: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Summaries of coarser groups, or of several batches, from those of their parts."""
    return summaries.groupBy(*group_cols).agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"),
        F.kll_merge_agg_double("sketch", F.lit(KLL_K)).alias("sketch"), F.hll_union_agg("runs").alias("runs"))


def quantiles(summaries: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Summaries with their mean, approximate quantiles and number of runs in place of the sketches."""
    got = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for p, n in zip(probs, names)]
    keep = [c for c in summaries.columns if c not in ("sketch", "runs", "total")]
    return summaries.select(*keep, (F.col("total") / F.col("n")).alias("mean"), *got, F.hll_sketch_estimate("runs").alias("n_runs"))
