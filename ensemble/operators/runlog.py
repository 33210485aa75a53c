"""Run outcomes, per-run pressure envelope, the run log and batch totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ALL_LEVERS, TARGET

RUN_KEY = ["reservoir_id", "sim_id"]


def classify_outcome(outcomes: DataFrame) -> DataFrame:
    """(exit_code, timed_out, exception, elapsed_s, limit_s) -> ok, error, runtime_s.

    A time-out wins, then a non-zero exit, then an exception raised while
    reading results; otherwise the run is ok and error is ''.
    """
    error = (
        F.when(F.col("timed_out"), F.format_string("timeout after %.0fs", F.col("limit_s").cast("double")))
        .when(F.coalesce(F.col("exit_code"), F.lit(0)) != 0,
              F.format_string("exit %d", F.col("exit_code")))
        .when(F.col("exception").isNotNull(), F.col("exception"))
        .otherwise(F.lit(""))
    )
    return outcomes.select(
        *RUN_KEY,
        (error == "").alias("ok"),
        error.alias("error"),
        F.col("elapsed_s").alias("runtime_s"),
    )


def converged(trajectory: DataFrame, classified: DataFrame) -> DataFrame:
    """Rows of converged runs only (a semi join: rows are never duplicated)."""
    ok = classified.where(F.col("ok")).select(*RUN_KEY)
    return trajectory.join(ok, RUN_KEY, "left_semi")


def pressure_envelope(trajectory: DataFrame, col: str = TARGET) -> DataFrame:
    """min / max / range of pressure per run (partial aggregation before the shuffle)."""
    return trajectory.groupBy(*RUN_KEY).agg(
        F.min(col).alias("fpr_min_psi"), F.max(col).alias("fpr_max_psi"),
    ).withColumn("fpr_range_psi", F.col("fpr_max_psi") - F.col("fpr_min_psi"))


def run_log(classified: DataFrame, levers: DataFrame, trajectory: DataFrame) -> DataFrame:
    """One row per run: outcome, levers (NULL where the reservoir lacks one) and
    the envelope; failed runs keep their row with a missing envelope."""
    env = pressure_envelope(trajectory)
    lv = levers.select(*RUN_KEY, *[F.col(c) for c in ALL_LEVERS])
    out = classified.join(lv, RUN_KEY, "left").join(env, RUN_KEY, "left")
    ok = F.col("ok")
    return out.select(
        *RUN_KEY, "ok", F.coalesce(F.col("error"), F.lit("")).alias("error"), "runtime_s",
        *ALL_LEVERS,
        F.when(ok, F.col("fpr_min_psi")).alias("fpr_min_psi"),
        F.when(ok, F.col("fpr_max_psi")).alias("fpr_max_psi"),
        F.when(ok, F.col("fpr_range_psi")).alias("fpr_range_psi"),
    )


def batch_summary(log: DataFrame) -> DataFrame:
    """Per reservoir: requested, converged, ratio, total and mean run time."""
    return log.groupBy("reservoir_id").agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count_if(F.col("ok")).alias("n_converged"),
        (F.count_if(F.col("ok")) / F.count(F.lit(1))).alias("converged_ratio"),
        F.sum("runtime_s").alias("total_runtime_s"),
        F.avg("runtime_s").alias("mean_runtime_s"),
    )
