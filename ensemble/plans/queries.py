"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the test tables of ``sf_dir`` (through the bindings of
:mod:`ensemble.sources.testdata`) and runs over all of their rows.
Double columns are rounded to 10 significant digits so that engines can be
compared (see :mod:`ensemble.plans.common`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formatting as fmt
from ..functions import pvt as pvt_fn
from ..functions.interp import interp, segment_index
from ..operators import explore, features, interval, metrics, quality, records, runlog, sampling, splits, summaries, text, wells
from ..operators import scenarios as rules
from ..schemas import (ALL_LEVERS, CORRELATION_COLUMNS, FEATURES, PVDG, PVTO_SATURATED, RESERVOIRS, TARGET,
                       TRAJECTORY_COLUMNS)
from ..sources import files, stores, testdata
from ..sources.dimensions import pvt_tables
from ..sources.dimensions import reservoir_dim as dim_table
from . import datasets as D
from .common import rounded

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
RUN_KEY = ["reservoir_id", "sim_id"]


def query(fn: Query) -> Query:
    def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(spark, sf_dir))
    wrapped.__name__ = fn.__name__
    wrapped.__doc__ = fn.__doc__
    REGISTRY[fn.__name__] = wrapped
    return wrapped


# --- scans, sources ---------------------------------------------------------

@query
def scan_trajectory(spark, sf):
    """The written dataset read back with the explicit 19-column schema (never
    inferred; NaN read as NULL)."""
    return files.read_trajectory(spark, D.trajectory_path(spark, sf)).select(*TRAJECTORY_COLUMNS)


@query
def scan_run_log(spark, sf):
    """The written run log of all reservoirs read back with the run-log schema;
    levers a reservoir lacks are NULL."""
    return files.read_run_log(spark, D.run_log_path(spark, sf), fmt="parquet")


@query
def scan_csv_checked(spark, sf):
    """A CSV with broken lines read with its schema: the accepted rows and, as they stand, the rejected lines."""
    schema = T.StructType([T.StructField("sim_id", T.LongType()), T.StructField("step", T.LongType()), T.StructField("pressure", T.DoubleType())])
    good, bad = files.read_csv_checked(spark, D.damaged_csv_path(spark, sf), schema, keys=("sim_id", "step"), header=False)
    return good.select(F.lit(True).alias("accepted"), F.concat_ws(",", "sim_id", "step").alias("record"), "pressure") \
        .union(bad.select(F.lit(False), "record", F.lit(0.0)))


@query
def ordered_store(spark, sf):
    """Every row of the stored dataset with its place in the order of (reservoir, run, step), taken from the
    files' key ranges and the row's index in its file, and whether the files' ranges rise without overlap."""
    path = D.ordered_trajectory_path(spark, sf)
    rising = stores.manifest(spark, path).agg(F.every("rising").alias("rising"))
    return stores.read_ordered(spark, path).select(*RUN_KEY, "step", "position").crossJoin(F.broadcast(rising))  # one row


@query
def batch_store(spark, sf):
    """The dataset as two batches of runs have written it."""
    rows = stores.read_batches(spark, D.batched_trajectory_path(spark, sf))
    return rows.select(*RUN_KEY, "step", TARGET, "batch")


@query
def pivot_summary_vectors(spark, sf):
    return features.pivot_summary_vectors(testdata.summary_vectors(spark, sf))


@query
def reservoir_dim(spark, sf):
    """Each run joined to its reservoir's registry row (broadcast dimension)."""
    dim = dim_table(spark).select(
        "reservoir_id", "unit_system", "baseline_pb", "baseline_porosity", "baseline_perm_md",
        "espesor_neto_m", "area_m2", "flow_timeout_s", "n_levers")
    return testdata.runs(spark, sf).join(dim, "reservoir_id")


# --- projections ------------------------------------------------------------

@query
def normalize_units(spark, sf):
    wide = features.pivot_summary_vectors(testdata.summary_vectors(spark, sf))
    dim = dim_table(spark).select("reservoir_id", "unit_system")
    return features.normalize_units(wide.join(dim, "reservoir_id")).drop("unit_system")


@query
def bubble_point(spark, sf):
    rf = features.run_features(D.scenarios(spark, sf))
    return rf.select(*RUN_KEY, "unit_system", "Presion_Burbuja_psi", "pvt_shift")


@query
def static_features(spark, sf):
    rf = features.run_features(D.scenarios(spark, sf))
    return rf.select(*RUN_KEY, "Porosidad", "Permeabilidad_mD", "Espesor_Neto_m", "Area")


@query
def dependent_lever(spark, sf):
    lv = sampling.with_dependent_levers(D.scenarios(spark, sf))
    return lv.where(F.col("qo_rate_high").isNotNull()).select(*RUN_KEY, "qo_rate_high", "qo_rate_low")


@query
def run_label(spark, sf):
    r = testdata.runs(spark, sf)
    return r.select(*RUN_KEY, fmt.run_label(F.col("reservoir_id"), F.col("sim_id")).alias("run_name"),
                    F.format_string("sim_%04d", F.col("sim_id")).alias("title"))


@query
def classify_outcome(spark, sf):
    return D.classified_runs(spark, sf)


# --- sampling ---------------------------------------------------------------

@query
def lhs_sample(spark, sf):
    return sampling.lhs_sample(testdata.runs(spark, sf), D.SEED).select(*RUN_KEY, *ALL_LEVERS)


@query
def lhs_rejection(spark, sf):
    return D.scenarios(spark, sf)


# --- features, run log --------------------------------------------------------

@query
def feature_table(spark, sf):
    return D.feature_rows(spark, sf)


@query
def step_index(spark, sf):
    tr = D.trajectory(spark, sf).select(*RUN_KEY, "tiempo_dias")
    return features.step_index(tr)


@query
def run_log(spark, sf):
    return D.run_log(spark, sf)


@query
def pressure_envelope(spark, sf):
    return runlog.pressure_envelope(D.trajectory(spark, sf))


@query
def batch_summary(spark, sf):
    return runlog.batch_summary(D.run_log(spark, sf))


@query
def union_runs(spark, sf):
    """Converged runs concatenated (rows of failed runs never enter)."""
    return D.trajectory(spark, sf).select(*RUN_KEY, "step", "tiempo_dias", "Presion_Reservorio_psi")


@query
def union_reservoirs(spark, sf):
    """The datasets of all reservoirs of the registry, each read as its own folder, combined by name: all
    rows, keyed by (reservoir, sim)."""
    tr = D.trajectory(spark, sf)
    return files.union_datasets([tr.where(F.col("reservoir_id") == r) for r in RESERVOIRS])


@query
def failure_logs(spark, sf):
    """The log kept of each failed run: the last lines of what it printed and of its error stream."""
    return text.failure_logs(testdata.run_streams(spark, sf, D.classified_runs(spark, sf)))


# --- PVT and lookups ----------------------------------------------------------


STEP_KEY = RUN_KEY + ["step"]


def _traj_p(spark, sf):
    return D.trajectory(spark, sf).select(*STEP_KEY, F.col(TARGET).alias("p"))


def _with_shift(spark, sf):
    rf = features.run_features(D.scenarios(spark, sf)).select(*RUN_KEY, "pvt_shift")
    return _traj_p(spark, sf).join(rf, RUN_KEY)


@query
def pvt_segments(spark, sf):
    """Rows per segment of the gas table (-1: below, 10: at/above the last node)."""
    return _traj_p(spark, sf).groupBy(segment_index(F.col("p"), [r[0] for r in PVDG]).alias("seg")) \
        .agg(F.count(F.lit(1)).alias("n_rows"))


@query
def interp_lookup(spark, sf):
    """Clamped lookup of the unshifted saturated Rs curve (Mscf/stb)."""
    grid = [r[1] for r in PVTO_SATURATED]
    return _traj_p(spark, sf).select(*STEP_KEY, "p", interp(F.col("p"), grid, [r[0] for r in PVTO_SATURATED])
                                     .alias("rs_mscf"))


@query
def shifted_grid(spark, sf):
    rf = features.run_features(D.scenarios(spark, sf))
    return rf.select(*RUN_KEY, F.posexplode(pvt_fn.shifted_grid_array(F.col("pvt_shift"))).alias("node", "pressure"))


@query
def pvt_rs(spark, sf):
    return _with_shift(spark, sf).select(*STEP_KEY, "p", pvt_fn.rs_from_pressure(F.col("p"), F.col("pvt_shift")).alias("rs"))


@query
def pvt_bo(spark, sf):
    return _with_shift(spark, sf).select(*STEP_KEY, "p", pvt_fn.bo_from_pressure(F.col("p"), F.col("pvt_shift")).alias("bo"))


@query
def pvt_bg(spark, sf):
    return _traj_p(spark, sf).select(*STEP_KEY, "p", pvt_fn.bg_from_pressure(F.col("p")).alias("bg"))


@query
def interp_join(spark, sf):
    """Tabular lookup of every pressure in every PVT table: rows x segments (equi key table_id, then
    x0 <= p < x1), interpolated. The first segment reaches down and the last one up without end and
    hold the end values there, so each row finds one segment of each table."""
    segs = pvt_tables(spark)
    ends = segs.groupBy("table_id").agg(F.max("seg").alias("last_seg"))
    segs = F.broadcast(segs.join(ends, "table_id"))  # fixed tables
    rows = _traj_p(spark, sf).withColumn("table_id", F.explode(F.array(*[F.lit(t) for t in ("pvdg_bg", "pvto_bo", "pvto_rs")])))
    p, first, last = F.col("p"), F.col("seg") == 0, F.col("seg") == F.col("last_seg")
    j = rows.join(segs, "table_id").where((first | (p >= F.col("x0"))) & (last | (p < F.col("x1"))))
    val = (F.when(p <= F.col("x0"), F.col("y0")).when(p >= F.col("x1"), F.col("y1"))
           .otherwise((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")) * (p - F.col("x0")) + F.col("y0")))
    return j.select(*STEP_KEY, "table_id", "p", "seg", val.alias("value"))


@query
def interp_asof(spark, sf):
    """The lookups of ``interp_join`` as an as-of join of rows and nodes (no broadcast, no range condition)."""
    segs = pvt_tables(spark)
    ends = segs.groupBy("table_id").agg(F.max_by("x1", "seg").alias("x"), F.max_by("y1", "seg").alias("y"))
    nodes = segs.select("table_id", F.col("x0").alias("x"), F.col("y0").alias("y")).union(ends)
    rows = _traj_p(spark, sf).withColumn("table_id", F.explode(F.array(*[F.lit(t) for t in ("pvdg_bg", "pvto_bo", "pvto_rs")])))
    return interval.interp_asof(rows, nodes, ["table_id"], "p").select(*STEP_KEY, "table_id", "p", "seg", "value")


@query
def interp_asof_runs(spark, sf):
    """Rs of every pressure in its own run's shifted table: as many tables as there are runs."""
    rf = features.run_features(D.scenarios(spark, sf)).select(*RUN_KEY, "pvt_shift")
    rs = F.array(*[F.lit(r[0]) for r in PVTO_SATURATED])
    nodes = rf.select(*RUN_KEY, F.posexplode(pvt_fn.shifted_grid_array(F.col("pvt_shift"))).alias("node", "x")) \
        .withColumn("y", F.get(rs, F.col("node")))
    return interval.interp_asof(_traj_p(spark, sf), nodes, RUN_KEY, "p").select(*STEP_KEY, "p", (F.col("value") * 1000.0).alias("rs"))


@query
def weighted_statics(spark, sf):
    """Weighted mean sum(w*x)/sum(w) and sum(w) per group (parts: w = size,
    x = retail price, group = brand)."""
    part = testdata.table(spark, sf, "part").withColumnRenamed("p_brand", "grp")
    return explore.weighted_mean(part, "p_size", "p_retailprice", ["grp"])


# --- scenario rules --------------------------------------------------------------

@query
def apply_injector_rate(spark, sf):
    return rules.apply_injector_rate(D.scenarios(spark, sf))


@query
def apply_producer_cap(spark, sf):
    return rules.apply_producer_cap(D.scenarios(spark, sf))


@query
def apply_equil(spark, sf):
    return rules.apply_equil(D.scenarios(spark, sf))


@query
def apply_multipliers(spark, sf):
    return rules.apply_multipliers(D.scenarios(spark, sf))


@query
def apply_pvto_shift(spark, sf):
    r = rules.apply_pvto_shift(D.scenarios(spark, sf))
    return r.select(*RUN_KEY, "record_no", "base_pressure", *[F.get(F.col("nums"), i).alias(f"n{i}") for i in range(4)],
                    F.size("nums").alias("n_nums"), "terminated", "shifted")


@query
def apply_group_rate(spark, sf):
    return rules.apply_group_rate(D.scenarios(spark, sf))


@query
def apply_scenario(spark, sf):
    return rules.apply_scenario(D.scenarios(spark, sf))


@query
def apply_scenario_files(spark, sf):
    """All rules on control tables that are assembled from keyword files."""
    controls = records.control_tables(files.read_keyword_lines(spark, D.control_files_path(spark, sf)))
    return rules.apply_scenario(D.scenarios(spark, sf), controls)


# --- text ------------------------------------------------------------------------

@query
def section_scan(spark, sf):
    lines = testdata.section_lines(spark, sf)
    place = F.col("turn").cast("long") * (1 << 31) + F.col("pos")
    out = text.section_scan(lines, header=F.col("header"), order_cols=("turn", "pos"), order=place)
    return out.select("file", "turn", "pos", "section", "n_tokens", "n_numbers", "terminated",
                      F.array_join("tokens", " ").alias("tokens"))


@query
def section_scan_files(spark, sf):
    """The conversations written as keyword files (a header line before each turn), each of a
    thousand conversations, and scanned split by split with the keyword rule for headers."""
    out = text.scan_keyword_files(files.read_keyword_lines(spark, D.keyword_files_path(spark, sf)))
    number = F.regexp_extract("file", r"bucket=(-?\d+)", 1).cast("long")
    return out.select(number.alias("file"), "lineno", "section", "n_tokens", "n_numbers", "terminated",
                      F.array_join("tokens", " ").alias("tokens"))


@query
def tail_lines(spark, sf):
    docs = testdata.table(spark, sf, "documents")
    return docs.select("doc_id", text.line_count("text").alias("n_lines"), text.tail_lines("text", 300).alias("tail"))


# --- quality ---------------------------------------------------------------------

@query
def validate_dataset(spark, sf):
    req = testdata.runs(spark, sf).agg(F.count(F.lit(1)).alias("n_requested"))
    return quality.validate_dataset(D.trajectory(spark, sf), req)


@query
def validate_stored(spark, sf):
    """The checks on the dataset as stored: its 19 columns, without a step."""
    req = testdata.runs(spark, sf).agg(F.count(F.lit(1)).alias("n_requested"))
    stored = files.read_trajectory(spark, D.trajectory_path(spark, sf)).select(*TRAJECTORY_COLUMNS)
    return quality.validate_dataset(stored, req)


@query
def monotonic_violations(spark, sf):
    return quality.monotonic_violations(D.trajectory(spark, sf))


@query
def variance_audit(spark, sf):
    return quality.variance_audit(D.trajectory(spark, sf))


def _field(spark, sf, name):
    return D.trajectory(spark, sf).where(F.col("reservoir_id") == name)


@query
def drift_report(spark, sf):
    return quality.drift_report(_field(spark, sf, "spe9"), _field(spark, sf, "norne"), FEATURES)


# --- exploration -----------------------------------------------------------------

@query
def median_by_step(spark, sf):
    return explore.median_by_step(D.trajectory(spark, sf))


DESCRIBE_COLUMNS = [c for c in TRAJECTORY_COLUMNS if c not in ("reservoir_id",)]


@query
def describe_columns(spark, sf):
    return explore.describe_columns(D.trajectory(spark, sf), DESCRIBE_COLUMNS)


@query
def histogram(spark, sf):
    tr = D.trajectory(spark, sf).select("reservoir_id", TARGET)
    return explore.histogram(tr, ["reservoir_id"], TARGET, 40)


@query
def correlation_matrix(spark, sf):
    return explore.correlation_matrix(D.trajectory(spark, sf), CORRELATION_COLUMNS)


@query
def drift_histogram(spark, sf):
    tr = D.trajectory(spark, sf).where(F.col("reservoir_id").isin("spe9", "norne"))
    long = explore.unpivot(tr, ["reservoir_id"], FEATURES, name="feature", value="x")
    return explore.histogram(long, ["reservoir_id", "feature"], "x", 40, density=True)


def _per_run_min(spark, sf):
    return D.trajectory(spark, sf).groupBy(*RUN_KEY).agg(F.min(TARGET).alias("fpr_min"))


@query
def rank_picks(spark, sf):
    picks = explore.rank_picks(_per_run_min(spark, sf), "fpr_min", ("first", "half", "last"))
    tr = D.trajectory(spark, sf)
    return tr.join(picks.select(*RUN_KEY, "pick"), RUN_KEY).select(
        *RUN_KEY, "pick", "step", TARGET, "Caudal_Prod_Petroleo_bbl", "Caudal_Iny_Agua_bbl",
        "Prod_Acumulada_Petroleo", "Iny_Acumulada_Agua")


@query
def rank_picks_thirds(spark, sf):
    """Runs at the ranks 0, n // 3, 2n // 3 and n - 1 of their lowest pressure, with their predicted traces
    (a persistence forecast: the pressure of the step before)."""
    tr = D.trajectory(spark, sf)
    picks = explore.rank_picks(_per_run_min(spark, sf), "fpr_min", ("first", "third", "two_thirds", "last"))
    before = tr.select(*RUN_KEY, (F.col("step") + 1).alias("step"), F.col(TARGET).alias("y_pred"))
    rows = tr.select(*STEP_KEY, F.col(TARGET).alias("y")).join(picks.select(*RUN_KEY, "pick"), RUN_KEY)
    return rows.join(before, STEP_KEY, "left").select(*STEP_KEY, "pick", "y", "y_pred")


@query
def summary_by_step(spark, sf):
    """Sketches by (batch, reservoir, step), merged over the batches: the approximate median's rank among the
    step's rows is held against the stated bound, the approximate number of runs against four standard errors."""
    rows = stores.read_batches(spark, D.batched_trajectory_path(spark, sf)).select("batch", *RUN_KEY, "step", TARGET)
    merged = summaries.merge(D.step_summaries(spark, sf), ["reservoir_id", "step"])
    got = summaries.quantiles(merged, [0.5], ["p50"])
    place = rows.join(got, ["reservoir_id", "step"]).groupBy("reservoir_id", "step", "n", "lo", "hi").agg(
        F.avg((F.col(TARGET) < F.col("p50")).cast("int")).alias("below"), F.avg((F.col(TARGET) <= F.col("p50")).cast("int")).alias("upto"),
        F.max("n_runs").alias("n_runs"))
    bound = summaries.RANK_ERROR + 1 / F.col("n")
    return place.select("reservoir_id", "step", "n", "lo", "hi", ((F.col("below") <= 0.5 + bound) & (F.col("upto") >= 0.5 - bound)).alias("median_within"),
                        (F.abs(F.col("n_runs") - F.col("n")) <= 1 + 0.065 * F.col("n")).alias("runs_within"))


@query
def trajectory_band(spark, sf):
    """The 5, 50 and 95 % band of the pressure over the runs of a reservoir, by step."""
    band = explore.quantile_band_by_step(D.trajectory(spark, sf))
    return band.select("reservoir_id", "step", F.col("`0.05`").alias("p05"), F.col("`0.5`").alias("p50"), F.col("`0.95`").alias("p95"))


@query
def rows_not_held_out(spark, sf):
    """Rows of all runs but the test runs, by an anti join on the run key."""
    tr = D.trajectory(spark, sf)
    return splits.rows_not_of(tr, splits.group_split(tr, seed=D.SEED), "test").select(*STEP_KEY, TARGET)


@query
def sample_sims(spark, sf):
    return explore.sample_runs(D.trajectory(spark, sf), k=8, seed=0)


@query
def pvt_curve(spark, sf):
    tr = D.trajectory(spark, sf)
    return explore.pvt_curve(tr, explore.sample_runs(tr, k=8, seed=0))


@query
def lever_sensitivity(spark, sf):
    return explore.lever_long(D.run_log(spark, sf))


@query
def lever_histogram(spark, sf):
    return explore.histogram(explore.lever_long(D.run_log(spark, sf), converged=False), ["reservoir_id", "lever"], "x", 20)


# --- splits ----------------------------------------------------------------------

@query
def group_split(spark, sf):
    return splits.group_split(D.trajectory(spark, sf), seed=D.SEED)


@query
def split_sizes(spark, sf):
    tr = D.trajectory(spark, sf)
    return splits.split_sizes(tr, splits.group_split(tr, seed=D.SEED))


@query
def group_kfold(spark, sf):
    return splits.group_kfold(D.trajectory(spark, sf), k=5)


# --- prediction metrics ------------------------------------------------------------

def _pred(spark, sf):
    return testdata.predictions(spark, sf)


@query
def regression_metrics(spark, sf):
    return metrics.regression_metrics(_pred(spark, sf), ["reservoir_id"])


def _baseline(spark, sf):
    p = _pred(spark, sf)
    train = splits.rows_by_fraction(p, 0.2, "train", seed=D.SEED)
    test = splits.rows_by_fraction(p, 0.2, "test", seed=D.SEED)
    return test, metrics.median_baseline(train, test, ["reservoir_id"])


@query
def median_baseline(spark, sf):
    return _baseline(spark, sf)[1]


@query
def metrics_report(spark, sf):
    test, base = _baseline(spark, sf)
    m = metrics.regression_metrics(test, ["reservoir_id"])
    return metrics.metrics_report(m, base, ["reservoir_id"])


@query
def per_sim_metrics(spark, sf):
    return metrics.per_sim_metrics(_pred(spark, sf))


@query
def residual_stats(spark, sf):
    return metrics.residual_stats(_pred(spark, sf), ["reservoir_id"])


@query
def best_worst_sims(spark, sf):
    ps = metrics.per_sim_metrics(_pred(spark, sf))
    both = explore.best_and_worst(ps, "mae", 3)
    # a run among the best is not listed again as one of the worst
    return both.where((F.col("kind") == "best") | (F.col("rank") >= 3)).select("reservoir_id", "kind", "rank", "sim_id", "mae", "r2")


@query
def pred_actual_bins(spark, sf):
    return explore.binned_2d(_pred(spark, sf), "y", "y_pred", 20, ["reservoir_id"])


# --- wells -----------------------------------------------------------------------

@query
def well_catalog(spark, sf):
    return wells.well_catalog(testdata.well_vectors(spark, sf))


@query
def key_catalog(spark, sf):
    return wells.key_catalog(testdata.well_vectors(spark, sf))


@query
def well_wide(spark, sf):
    return wells.well_wide(testdata.well_vectors(spark, sf))


@query
def run_comparison(spark, sf):
    """All runs of the table side by side, their labels taken from the data."""
    return wells.run_comparison(testdata.well_vectors(spark, sf))
