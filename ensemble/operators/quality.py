"""Dataset validation, monotone cumulatives, variance audit and drift between fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import (CUMULATIVE_COLUMNS, LEAKAGE_COLUMNS, SCHEMA_COLUMNS, TARGET,
                       ZERO_VARIANCE_COLUMNS)
from .ranking import ordered_scan

RUN_KEY = ["reservoir_id", "sim_id"]
#: A cumulative may fall by at most this much between consecutive steps.
CUMULATIVE_TOLERANCE = 1.0
MIN_CONVERGED_FRACTION = 0.8
MIN_PRESSURE_RANGE_PSI = 100.0

FINDING = "check string, column string, passed boolean, observed double, threshold double, message string"


def is_missing(c) -> F.Column:
    """NULL or NaN (NaN is how the source files spell missing)."""
    return c.isNull() | F.isnan(c)


def _finding(check, column, passed, observed, threshold, message):
    return F.struct(
        F.lit(check).alias("check"),
        (F.lit(column) if column is not None else F.lit(None).cast("string")).alias("column"),
        passed.alias("passed"),
        observed.cast("double").alias("observed"),
        (F.lit(float(threshold)) if threshold is not None else F.lit(None).cast("double")).alias("threshold"),
        message.alias("message"),
    )


def step_order(df: DataFrame, cols: Sequence[str] = CUMULATIVE_COLUMNS) -> list[str] | None:
    """Order of a run's rows: ``step`` if there is one; in a stored dataset the time, rows of
    equal time by their cumulatives; None without either."""
    if "step" in df.columns:
        return ["step"]
    return ["tiempo_dias", *[c for c in cols if c in df.columns]] if "tiempo_dias" in df.columns else None


def cumulative_deltas(df: DataFrame, cols: Sequence[str] = CUMULATIVE_COLUMNS,
                      order_cols: Sequence[str] = ("step",), rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Adds ``d_<col>`` = value minus the previous step's value (NULL on a run's first row)."""
    scanned = ordered_scan(df, [c for c in RUN_KEY if c in df.columns], list(order_cols),
                           previous={f"p_{c}": c for c in cols}, rows_per_chunk=rows_per_chunk)
    return scanned.select(*df.columns, *[(F.col(c) - F.col(f"p_{c}")).alias(f"d_{c}") for c in cols])


def monotonic_violations(df: DataFrame, cols: Sequence[str] = CUMULATIVE_COLUMNS,
                         tolerance: float = CUMULATIVE_TOLERANCE) -> DataFrame:
    """(reservoir_id, sim_id, step, column, delta) for every fall larger than tolerance."""
    present = [c for c in cols if c in df.columns]
    d = cumulative_deltas(df.select(*RUN_KEY, "step", *present), present)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("delta")) for c in present])
    return (d.select(*RUN_KEY, "step", F.inline(entries))
            .where(F.col("delta") < F.lit(-tolerance)))


def validate_dataset(df: DataFrame, n_requested: DataFrame | int) -> DataFrame:
    """All findings of the dataset checks as rows; ``passed`` false marks a problem.

    Checks: empty dataset (short-circuits everything else), missing schema
    columns (each reported), missing values, converged runs below
    ``floor(0.8 * n_requested)``, cumulatives falling by more than 1.0 within a
    run, and a global pressure range under 100 psi. A check whose columns are
    missing is left out. One aggregation pass plus one chunked window pass;
    nothing is collected.
    """
    spark = df.sparkSession
    missing = [c for c in SCHEMA_COLUMNS if c not in df.columns]
    present = [c for c in SCHEMA_COLUMNS if c in df.columns]
    key = [c for c in RUN_KEY if c in df.columns]
    by_run = "sim_id" in key
    order = step_order(df)
    cums = [c for c in CUMULATIVE_COLUMNS if c in df.columns] if by_run and order else []
    if isinstance(n_requested, int):
        req = spark.range(1).select(F.lit(n_requested).cast("long").alias("n_requested"))
    else:
        req = n_requested.select(F.col("n_requested").cast("long"))
    null_cells = sum((F.count_if(is_missing(F.col(c)) if c != "reservoir_id" else F.col(c).isNull())
                      for c in present), F.lit(0))
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"), null_cells.alias("null_cells"),
                   *([F.count_distinct(*key).alias("n_sims")] if by_run else []),
                   *([(F.max(TARGET) - F.min(TARGET)).alias("p_range")] if TARGET in present else []))
    row = F.broadcast(stats).crossJoin(F.broadcast(req))  # 1 x 1
    if cums:
        deltas = cumulative_deltas(df.select(*dict.fromkeys([*key, *order, *cums])), cums, order)
        row = row.crossJoin(F.broadcast(deltas.agg(*[F.min(f"d_{c}").alias(f"w_{c}") for c in cums])))  # x 1
    no_text = F.lit("")
    findings = [_finding("empty", None, F.col("n_rows") > 0, F.col("n_rows"), None,
                         F.when(F.col("n_rows") == 0, F.lit("no rows: not one run was kept")).otherwise(no_text))]
    findings += [_finding("missing_column", c, F.lit(False), F.lit(None), None, F.lit(f"column {c} is not there")) for c in missing]
    findings.append(_finding("null_values", None, F.col("null_cells") == 0, F.col("null_cells"), 0,
                             F.when(F.col("null_cells") > 0, F.format_string("%d cells without a value", F.col("null_cells")))
                             .otherwise(no_text)))
    if by_run:
        floor_n = F.floor(F.col("n_requested") * F.lit(MIN_CONVERGED_FRACTION))
        findings.append(_finding("converged", None, F.col("n_sims") >= floor_n, F.col("n_sims"), None,
                                 F.format_string("runs kept: %d of %d", F.col("n_sims"), F.col("n_requested"))))
    for c in cums:
        w = F.col(f"w_{c}")
        ok = w.isNull() | (w >= F.lit(-CUMULATIVE_TOLERANCE))
        findings.append(_finding("monotonic", c, ok, w, -CUMULATIVE_TOLERANCE,
                                 F.when(ok, no_text).otherwise(F.lit(f"a run's {c} goes down"))))
    if TARGET in present:
        findings.append(_finding("pressure_range", TARGET, F.coalesce(F.col("p_range") >= F.lit(MIN_PRESSURE_RANGE_PSI), F.lit(False)),
                                 F.col("p_range"), MIN_PRESSURE_RANGE_PSI,
                                 F.format_string("all pressures lie within %.0f psi", F.floor(F.col("p_range") + 0.5).cast("double"))))
    out = row.select(F.col("n_rows"), F.inline(F.array(*findings)))
    # empty dataset: only the first finding is reported
    return out.where((F.col("n_rows") > 0) | (F.col("check") == "empty")).drop("n_rows")


def variance_audit(df: DataFrame, group_cols: Sequence[str] = ("reservoir_id",)) -> DataFrame:
    """Sample variance of the excluded columns with the reason for excluding them."""
    cols = [c for c in LEAKAGE_COLUMNS + ZERO_VARIANCE_COLUMNS if c in df.columns]
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in cols])
    long = df.select(*group_cols, F.inline(entries))
    reason = F.when(F.col("column").isin(LEAKAGE_COLUMNS), F.lit("leakage: computed from the target pressure")) \
        .otherwise(F.lit("no variance inside a reservoir"))
    # a constant column is detected exactly (min == max); merged partial
    # variances of equal values can otherwise come out as 1e-26 instead of 0
    agg = long.groupBy(*group_cols, "column").agg(
        F.var_samp("x").alias("__var"), (F.min("x") == F.max("x")).alias("zero_variance"))
    variance = F.when(F.col("zero_variance") & F.col("__var").isNotNull(), F.lit(0.0)).otherwise(F.col("__var"))
    return agg.select(*group_cols, "column", variance.alias("variance"), reason.alias("reason"),
                      F.coalesce(F.col("zero_variance"), F.lit(False)).alias("zero_variance"))


def drift_report(a: DataFrame, b: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: range of reference ``a`` and of ``b``, out-of-range flag
    (``min_b < min_a or max_b > max_a``) and the share of b's rows outside a's range."""
    def long(df):
        entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                            for c in features])
        return df.select(F.inline(entries))
    ra = long(a).groupBy("feature").agg(F.min("x").alias("min_a"), F.max("x").alias("max_a"))
    lb = long(b).join(F.broadcast(ra), "feature")  # one row per feature: bounded
    rb = lb.groupBy("feature").agg(
        F.min("x").alias("min_b"), F.max("x").alias("max_b"),
        F.avg(((F.col("x") < F.col("min_a")) | (F.col("x") > F.col("max_a"))).cast("double")).alias("share_out"),
        F.first("min_a").alias("min_a"), F.first("max_a").alias("max_a"))
    return rb.select("feature", "min_a", "max_a", "min_b", "max_b",
                     ((F.col("min_b") < F.col("min_a")) | (F.col("max_b") > F.col("max_a"))).alias("out_of_range"),
                     "share_out")


def exit_status(findings: DataFrame) -> int:
    """Process exit status of a validation run: 2 when any check failed, else 0
    (one scalar back to the driver)."""
    failed = findings.agg(F.count_if(~F.col("passed")).alias("n")).first()["n"]
    return 2 if failed else 0
