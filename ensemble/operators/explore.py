"""Exploratory aggregates behind the ensemble figures (data only, no drawing)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..schemas import ALL_LEVERS, CUMULATIVE_COLUMNS, TARGET
from .ranking import ACCURACY, exact_quantiles, global_rank, ordered_scan

RUN_KEY = ["reservoir_id", "sim_id"]


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
            name: str = "column", value: str = "value") -> DataFrame:
    """Wide -> long (ids..., name, value); no shuffle."""
    entries = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*ids, F.inline(entries))


def median_by_step(df: DataFrame, cols: Sequence[str] = (TARGET, *CUMULATIVE_COLUMNS),
                   group_cols: Sequence[str] = ("reservoir_id", "step"), exact: bool = True) -> DataFrame:
    """Median over runs at each step of each column (exact and interpolated, or
    ``exact=False``: one pass of ``percentile_approx`` with bounded memory)."""
    if not exact:
        return df.groupBy(*group_cols).agg(
            *[F.percentile_approx(F.col(c), 0.5, 10_000).alias(c) for c in cols])
    long = unpivot(df, list(group_cols), cols)
    med = exact_quantiles(long, [*group_cols, "column"], "value", [0.5])
    return med.groupBy(*group_cols).agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in cols])


def quantile_band_by_step(df: DataFrame, col: str = TARGET, probs: Sequence[float] = (0.05, 0.5, 0.95),
                          group_cols: Sequence[str] = ("reservoir_id", "step")) -> DataFrame:
    """Per step, the band of a column over runs (default 5/50/95 %), exact.
    The compact form of drawing every run's trajectory for large ensembles."""
    q = exact_quantiles(df.select(*group_cols, F.col(col).cast("double").alias("__x")),
                        list(group_cols), "__x", list(probs))
    return q.groupBy(*group_cols).agg(
        *[F.max(F.when(F.col("q") == float(p), F.col("value"))).alias(str(float(p))) for p in probs])


def weighted_mean(df: DataFrame, weight: str, value: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """sum(w * x) / sum(w) and sum(w) per group (e.g. thickness-weighted porosity)."""
    w, x = F.col(weight).cast("double"), F.col(value).cast("double")
    return df.groupBy(*group_cols).agg((F.sum(w * x) / F.sum(w)).alias("weighted_mean"),
                                       F.sum(w).alias("total_weight"))


def describe_columns(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75 %, max per column (one row each).
    Quartiles are exact (distributed ranking) or, with ``exact=False``,
    approximate from one aggregation pass."""
    long = unpivot(df, [], cols).where(F.col("value").isNotNull())
    base = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("__std"), F.min("value").alias("min"), F.max("value").alias("max"))
    # equal values give exactly 0 (merged partial moments need not)
    base = base.withColumn("std", F.when((F.col("min") == F.col("max")) & F.col("__std").isNotNull(), F.lit(0.0))
                           .otherwise(F.col("__std"))).drop("__std")
    if exact:
        q = exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75])
        qw = q.groupBy("column").agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(name)
                                       for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    else:
        qw = long.groupBy("column").agg(F.percentile_approx("value", [0.25, 0.5, 0.75], 10_000).alias("__q")) \
            .select("column", *[F.col("__q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))])
    return base.join(qw, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def histogram(long: DataFrame, group_cols: Sequence[str], value_col: str, bins: int,
              density: bool = False) -> DataFrame:
    """Equal-width histogram over each group's [min, max]; the last bin is closed;
    a constant group is widened to [x-0.5, x+0.5]; empty bins are kept (count 0).

    Returns (group..., bin, lo, hi, count[, density]).
    """
    group = list(group_cols)
    x = F.col(value_col)
    vals = long.where(x.isNotNull() & ~F.isnan(x))
    rng = vals.groupBy(*group).agg(F.min(x).alias("__mn"), F.max(x).alias("__mx"), F.count(F.lit(1)).alias("__n"))
    rng = rng.select(
        *group, "__n",
        F.when(F.col("__mn") == F.col("__mx"), F.col("__mn") - 0.5).otherwise(F.col("__mn")).alias("__lo"),
        F.when(F.col("__mn") == F.col("__mx"), F.col("__mx") + 0.5).otherwise(F.col("__mx")).alias("__hi"))
    lo, hi = F.col("__lo"), F.col("__hi")
    width = (hi - lo) / F.lit(float(bins))

    def edge(k):  # numpy's linspace edges: k * width + lo, the last one exactly hi
        return F.when(k >= bins, hi).otherwise(k * width + lo)
    # numpy's bin index: scaled offset, then corrected against the edges
    i0 = F.least(F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1))
    i1 = F.when(x < edge(i0), i0 - 1).otherwise(i0)
    idx = F.when((x >= edge(i1 + 1)) & (i1 != bins - 1), i1 + 1).otherwise(i1).cast("int")
    # one row per group: Spark broadcasts them at run time if they are few
    joined = vals.join(rng, group) if group else vals.crossJoin(F.broadcast(rng))
    binned = joined.groupBy(*group, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = rng.select(*group, "__n", "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = frame.join(binned, group + ["bin"], "left").select(
        *group, "bin",
        (F.col("__lo") + F.col("bin") * width).alias("lo"),
        F.when(F.col("bin") == bins - 1, F.col("__hi")).otherwise(F.col("__lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
        "__n", width.alias("__w"))
    if density:
        out = out.withColumn("density", F.col("count") / (F.col("__n") * F.col("__w")))
    return out.drop("__n", "__w")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pooled Pearson correlation of every pair (pairwise-complete rows), lazily.

    Rows are summed by which of their values are missing (a bit mask: one group
    where nothing is): counts, sums and products of the values less the column's
    mean. A pair then adds up the groups in which both are there, so one aggregation
    gives every pair its own rows. A column that is constant on them gives NULL, never
    a division by zero. Returns (col_a, col_b, corr) for all ordered pairs including
    the diagonal.
    """
    cols = [c for c in cols if c in df.columns]
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    means = d.agg(*[F.avg(c).alias(f"m_{c}") for c in cols])
    zero = F.lit(0.0)
    mask = sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(cols)), F.lit(0))
    cen = d.crossJoin(F.broadcast(means)).select(  # one row
        mask.alias("mask"), *cols, *[F.coalesce(F.col(c) - F.col(f"m_{c}"), zero).alias(f"c_{c}") for c in cols])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    g = cen.groupBy("mask").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"c_{c}").alias(f"s_{i}") for i, c in enumerate(cols)],
        *[F.sum(F.col(f"c_{cols[i]}") * F.col(f"c_{cols[j]}")).alias(f"q_{i}_{j}") for i, j in pairs],
        *[f(c).alias(f"{name}_{i}") for i, c in enumerate(cols) for name, f in (("lo", F.min), ("hi", F.max))])
    recs = F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit((1 << i) | (1 << j)).alias("need"), F.col(f"q_{i}_{j}").alias("sab"), F.col(f"q_{i}_{i}").alias("saa"),
        F.col(f"q_{j}_{j}").alias("sbb"), F.col(f"s_{i}").alias("sa"), F.col(f"s_{j}").alias("sb"), F.col(f"lo_{i}").alias("loa"),
        F.col(f"hi_{i}").alias("hia"), F.col(f"lo_{j}").alias("lob"), F.col(f"hi_{j}").alias("hib")) for i, j in pairs])
    kept = g.select("mask", "n", F.inline(recs)).withColumn("there", F.col("mask").bitwiseAND(F.col("need")) == 0)
    there = lambda c: F.when(F.col("there"), F.col(c))
    per = kept.groupBy("i", "j").agg(
        F.coalesce(F.sum(there("n")), F.lit(0)).alias("n"), *[F.sum(there(c)).alias(c) for c in ("sab", "saa", "sbb", "sa", "sb")],
        ((F.min(there("loa")) < F.max(there("hia"))) & (F.min(there("lob")) < F.max(there("hib")))).alias("varies"))
    n = F.col("n")
    cab = F.col("sab") - F.col("sa") * F.col("sb") / n
    caa = F.col("saa") - F.col("sa") * F.col("sa") / n
    cbb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    r = F.when((n > 1) & F.coalesce(F.col("varies"), F.lit(False)), F.when((caa > 0) & (cbb > 0), F.try_divide(cab, F.sqrt(caa * cbb))))
    names = F.array(*[F.lit(c) for c in cols])
    a, b = F.get(names, F.col("i")), F.get(names, F.col("j"))
    both = F.array(F.struct(a.alias("col_a"), b.alias("col_b"), r.alias("corr")), F.struct(b.alias("col_a"), a.alias("col_b"), r.alias("corr")))
    return per.select(F.inline(F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)))


#: Rank of a position among n rows, and its share of them.
POSITIONS = {"first": (lambda n: F.lit(0), 0.0), "half": (lambda n: F.floor(n / 2), 0.5), "third": (lambda n: F.floor(n / 3), 1 / 3),
             "two_thirds": (lambda n: F.floor(2 * n / 3), 2 / 3), "last": (lambda n: n - 1, 1.0)}


def rank_picks(per_run: DataFrame, measure: str, positions: Sequence[str] = ("first", "half", "last"),
               group_cols: Sequence[str] = ("reservoir_id",)) -> DataFrame:
    """Runs at rank positions of ascending ``measure`` within each group, without ranking all runs.

    positions: 'first' (0), 'half' (n//2), 'third' (n//3), 'two_thirds' (2n//3),
    'last' (n-1); ties are broken by sim_id, NULL measures take no part. Approximate
    quantiles bracket each wanted rank for certain; the values inside a bracket are
    counted (all below as one), which gives the value at the rank and how many of its
    equals come before; only runs of that value are put in order of their ids.
    Returns (group..., pick, sim_id, measure).
    """
    group = list(group_cols)
    runs = per_run.where(F.col(measure).isNotNull()).select(*group, "sim_id", F.col(measure))
    shares = [POSITIONS[p][1] for p in positions]
    at = rank_values(runs, group, measure, list(positions), shares)
    ties = runs.join(at.select(*group, F.col("value").alias(measure), "pick", "skip"), [*group, measure])
    order = global_rank(ties, "sim_id", [], partition_cols=[*group, "pick"], rank_col="__rank")
    return order.where(F.col("__rank") == F.col("skip")).select(*group, "pick", "sim_id", measure)


def rank_values(rows: DataFrame, group: Sequence[str], col: str, positions: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(group..., pick, value, skip): the value at each position and the number of its equals before it."""
    group, margin, v = list(group), 2.0 / ACCURACY, F.col(col)
    low, high = [max(0.0, s - margin) for s in shares], [min(1.0, s + margin) for s in shares]
    stats = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(v, low, ACCURACY).alias("__low"),
                                     F.percentile_approx(v, high, ACCURACY).alias("__high"), F.min(v).alias("__min"), F.max(v).alias("__max"))
    few = F.col("__n") < ACCURACY
    wanted = stats.select(*group, F.inline(F.array(*[F.struct(
        F.lit(p).alias("pick"), POSITIONS[p][0](F.col("__n")).cast("long").alias("__pos"),
        F.when(few | F.lit(low[i] == 0.0), F.col("__min")).otherwise(F.get("__low", i)).alias("__lo"),
        F.when(few | F.lit(high[i] == 1.0), F.col("__max")).otherwise(F.get("__high", i)).alias("__hi")) for i, p in enumerate(positions)])))
    near = rows.select(*group, v.alias("__v")).join(wanted, group).where(F.col("__v") <= F.col("__hi"))
    counts = near.groupBy(*group, "pick", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("value")).agg(
        F.count(F.lit(1)).alias("__c"), F.max("__pos").alias("__pos"))
    w = Window.partitionBy(*group, "pick").orderBy(F.col("value").asc_nulls_first())
    upto = counts.withColumn("__upto", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return upto.where((F.col("__upto") > F.col("__pos")) & (F.col("__upto") - F.col("__c") <= F.col("__pos"))) \
        .select(*group, "pick", "value", (F.col("__pos") - F.col("__upto") + F.col("__c")).alias("skip"))


def sample_runs(runs: DataFrame, k: int = 8, seed: int = 0,
                group_cols: Sequence[str] = ("reservoir_id",)) -> DataFrame:
    """min(k, n) distinct runs per group in seeded hash order (a sampling operator). Each task keeps its
    own first k of a group before the shuffle."""
    r = runs.select(*group_cols, "sim_id").distinct().withColumn(
        "__h", hash_uniform(seed, *[F.col(c) for c in group_cols], F.col("sim_id")))
    return first_k(r, k, ["__h", "sim_id"], group_cols, "sample_rank").drop("__h")


def first_k(df: DataFrame, k: int, order: Sequence, group_cols: Sequence[str], rank_col: str) -> DataFrame:
    """The first k rows of each group with their place from 0; a limited window, so that no task sends more than k of a group."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k).withColumn(rank_col, (F.col(rank_col) - 1).cast("long"))


def best_and_worst(per_run: DataFrame, measure: str, k: int = 3, group_cols: Sequence[str] = ("reservoir_id",)) -> DataFrame:
    """The k runs of the smallest and of the largest ``measure`` of each group with their ranks (ties by sim_id);
    a run may be both where there are fewer than 2k. Runs without a measure come first, as NULLs do."""
    group = list(group_cols)
    best = first_k(per_run, k, [measure, "sim_id"], group, "rank").withColumn("kind", F.lit("best"))
    worst = first_k(per_run, k, [F.desc(measure), F.desc("sim_id")], group, "__back").withColumn("kind", F.lit("worst"))
    n = per_run.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    worst = worst.join(n, group).withColumn("rank", F.col("__n") - 1 - F.col("__back")).drop("__n", "__back")
    return best.unionByName(worst)


def pvt_curve(df: DataFrame, sims: DataFrame) -> DataFrame:
    """Rows of the picked runs with their position in ascending pressure order."""
    rows = df.join(sims.select(*RUN_KEY), RUN_KEY, "left_semi").select(
        *RUN_KEY, "step", TARGET, "Bo_rb_stb", "Bg_rb_scf", "Rs_scf_stb")
    return ordered_scan(rows, RUN_KEY, [TARGET, "step"], index_col="curve_pos")


def lever_long(log: DataFrame, levers: Sequence[str] = ALL_LEVERS, converged: bool = True) -> DataFrame:
    """Run log -> (reservoir_id, sim_id, lever, x, fpr_min_psi, fpr_max_psi) for the levers each
    reservoir has, of converged runs or (``converged=False``) of all."""
    entries = F.array(*[F.struct(F.lit(lv).alias("lever"), F.col(lv).alias("x")) for lv in levers])
    return (log.where(F.col("ok") if converged else F.lit(True))
            .select(*RUN_KEY, "fpr_min_psi", "fpr_max_psi", F.inline(entries))
            .where(F.col("x").isNotNull())
            .select(*RUN_KEY, "lever", "x", "fpr_min_psi", "fpr_max_psi"))


def binned_2d(df: DataFrame, x: str, y: str, bins: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts on a bins x bins grid over the common [min, max] of x and y (for
    scatter plots of many points). Returns (group..., bx, by, count)."""
    group = list(group_cols)
    rng = df.groupBy(*group).agg(F.least(F.min(x), F.min(y)).alias("__lo"),
                                 F.greatest(F.max(x), F.max(y)).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")

    def idx(c):
        return F.when(span > 0, F.least(F.floor((F.col(c) - F.col("__lo")) / span * F.lit(float(bins))),
                                        F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    j = df.join(rng, group) if group else df.crossJoin(F.broadcast(rng))
    return j.groupBy(*group, idx(x).alias("bx"), idx(y).alias("by")).agg(F.count(F.lit(1)).alias("count"))


__all__ = ["unpivot", "median_by_step", "describe_columns", "histogram", "correlation_matrix",
           "rank_picks", "sample_runs", "pvt_curve", "lever_long", "binned_2d", "quantile_band_by_step",
           "weighted_mean", "first_k", "best_and_worst", "rank_values"]
