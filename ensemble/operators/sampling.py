"""Scenario sampling: Latin hypercube with validator-driven redraws.

``lhs_sample``: for n runs of a reservoir, every lever gets n equal strata,
one jittered point per stratum, and the strata are assigned to runs by an
independent seeded permutation per lever (a rank of a hash draw, computed with
:func:`global_rank`, never one unpartitioned sort).

``lhs_rejection``: a sample the reservoir's validator rejects is replaced by a
fresh uniform draw of *all* levers, up to 50 times; the 50th redraw is kept even
if it is still invalid. Row-local: the attempts are an array expression
evaluated only for rows whose first sample fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..schemas import ALL_LEVERS, RESERVOIRS, SPE9_PB_MARGIN_PSI, THROTTLE_RATIO
from ..sources.dimensions import lever_ranges, reservoir_dim
from .ranking import global_rank

MAX_REDRAWS = 50
#: Attempts tested by compiled CASE branches before the array form takes over.
UNROLLED_ATTEMPTS = 8

Getter = Callable[[str], Column]


def _spe9_validator(get: Getter) -> Column:
    pb_new = F.lit(RESERVOIRS["spe9"]["baseline_pb"]) + get("pb_shift")
    return get("p_init") >= pb_new + F.lit(SPE9_PB_MARGIN_PSI)


#: Reservoir -> validator building a boolean Column from lever values.
VALIDATORS: dict[str, Callable[[Getter], Column]] = {"spe9": _spe9_validator}


def is_valid(reservoir: Column, get: Getter) -> Column:
    expr = None
    for name, fn in VALIDATORS.items():
        expr = (F.when(reservoir == name, fn(get)) if expr is None
                else expr.when(reservoir == name, fn(get)))
    return F.lit(True) if expr is None else expr.otherwise(F.lit(True))


def lhs_sample(runs: DataFrame, seed: int = 42) -> DataFrame:
    """runs(reservoir_id, sim_id) -> (reservoir_id, sim_id, <every lever>) with NULL
    for levers the reservoir does not have."""
    spark = runs.sparkSession
    runs = runs.select("reservoir_id", "sim_id")
    n_runs = runs.groupBy("reservoir_id").agg(F.count(F.lit(1)).alias("n_runs"))  # one row per reservoir
    cells = (
        runs.join(lever_ranges(spark), "reservoir_id").join(n_runs, "reservoir_id")
        .withColumn("h", hash_uniform(seed, F.col("reservoir_id"), F.col("lever"), "perm", F.col("sim_id")))
    )
    ranked = global_rank(cells, "h", ["sim_id"], partition_cols=["reservoir_id", "lever"],
                         rank_col="stratum")
    jitter = hash_uniform(seed, F.col("reservoir_id"), F.col("lever"), "jitter", F.col("sim_id"))
    u = (F.col("stratum") + jitter) / F.col("n_runs")
    valued = ranked.select(
        "reservoir_id", "sim_id", "lever", (F.col("lo") + u * (F.col("hi") - F.col("lo"))).alias("value"))
    lever, value = F.col("lever"), F.col("value")
    return valued.groupBy("reservoir_id", "sim_id").agg(
        *[F.max(F.when(lever == lv, value)).alias(lv) for lv in ALL_LEVERS])


def lhs_rejection(sample: DataFrame, seed: int = 42) -> DataFrame:
    """Apply validators with up to 50 redraws; adds ``attempt`` (0 = LHS point).

    The attempt is a lazy ``CASE`` chain: attempt k is only drawn when 0..k-1
    failed, and only the levers the validator reads are drawn to test it; the
    kept sample's levers are drawn once from the chosen attempt. The first
    attempts are compiled branches; the rare rows that need more scan the
    remaining attempts as an array. Row-local throughout.
    """
    spark = sample.sparkSession
    dim = reservoir_dim(spark).select("reservoir_id", *[f"{lv}_{e}" for lv in ALL_LEVERS for e in ("lo", "hi")])
    s = sample.join(dim, "reservoir_id")
    res, sim = F.col("reservoir_id"), F.col("sim_id")

    def redraw(lever: str, a: Column) -> Column:
        lo, hi = F.col(f"{lever}_lo"), F.col(f"{lever}_hi")
        u = hash_uniform(seed, res, F.lit(lever), "redraw", a, sim)
        return F.when(lo.isNotNull(), lo + u * (hi - lo))

    attempt = F.when(is_valid(res, lambda k: F.col(k)), F.lit(0))
    for a in range(1, UNROLLED_ATTEMPTS + 1):
        attempt = attempt.when(is_valid(res, lambda k, a=a: redraw(k, F.lit(a))), F.lit(a))
    # rows still invalid after the unrolled attempts (rare): scan the rest in order
    rest = F.filter(F.sequence(F.lit(UNROLLED_ATTEMPTS + 1), F.lit(MAX_REDRAWS - 1)),
                    lambda a: is_valid(res, lambda k: redraw(k, a)))
    attempt = attempt.otherwise(F.coalesce(F.get(rest, 0), F.lit(MAX_REDRAWS)))
    s = s.withColumn("attempt", attempt)
    chosen = [F.when(F.col("attempt") == 0, F.col(lv)).otherwise(redraw(lv, F.col("attempt"))).alias(lv)
              for lv in ALL_LEVERS]
    return s.select("reservoir_id", "sim_id", "attempt", *chosen)


def with_dependent_levers(levers: DataFrame) -> DataFrame:
    """``qo_rate_low`` defaults to ``qo_rate_high * 100/1500`` unless given."""
    given = F.col("qo_rate_low") if "qo_rate_low" in levers.columns else F.lit(None).cast("double")
    return levers.withColumn("qo_rate_low", F.coalesce(given, F.col("qo_rate_high") * F.lit(THROTTLE_RATIO)))
