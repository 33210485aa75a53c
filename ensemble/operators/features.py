"""Summary vectors -> typed trajectory rows (the 19-column feature table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pvt, units
from ..schemas import SUMMARY_KEYS, TRAJECTORY_COLUMNS
from ..sources.dimensions import reservoir_dim
from .ranking import ordered_scan

RUN_KEY = ["reservoir_id", "sim_id"]


def pivot_summary_vectors(vectors: DataFrame) -> DataFrame:
    """Long (reservoir_id, sim_id, step, key, value) -> one row per step, one
    column per vector (NULL where a vector has no value at that step).

    Conditional aggregation over the fixed key list: a single aggregation with
    map-side partial results, so one shuffle (``pivot`` would add a second
    aggregation round). It shuffles on (run, step), which splits even a huge
    run evenly across tasks.
    """
    key, value = F.col("key"), F.col("value")
    return vectors.groupBy(*RUN_KEY, "step").agg(
        *[F.max(F.when(key == k, value)).alias(k) for k in SUMMARY_KEYS])


def step_index(df: DataFrame, order_cols=("tiempo_dias",), step_col: str = "step",
               rows_per_chunk: int = 1_000_000) -> DataFrame:
    """0-based position of each row within its run (``cumcount`` in time order)."""
    return ordered_scan(df, RUN_KEY, list(order_cols), index_col=step_col,
                        rows_per_chunk=rows_per_chunk)


def run_features(levers: DataFrame) -> DataFrame:
    """Run-level scalars: levers applied to the reservoir's baselines.

    levers(reservoir_id, sim_id, <levers>) -> (reservoir_id, sim_id, unit_system,
    Porosidad, Permeabilidad_mD, Espesor_Neto_m, Area, Presion_Burbuja_psi, pvt_shift).
    """
    dim = reservoir_dim(levers.sparkSession)
    lv = levers.join(dim, "reservoir_id")
    return lv.select(
        *RUN_KEY,
        "unit_system",
        (F.col("baseline_porosity") * F.col("phi_mult")).alias("Porosidad"),
        (F.col("baseline_perm_md") * F.col("k_mult")).alias("Permeabilidad_mD"),
        F.col("espesor_neto_m").alias("Espesor_Neto_m"),
        F.col("area_m2").alias("Area"),
        units.bubble_point_psi(F.col("unit_system"), F.col("baseline_pb"),
                               F.col("pb_shift"), F.col("p_init_shift_bar")).alias("Presion_Burbuja_psi"),
        checked_shift(units.pvt_shift(F.col("unit_system"), F.col("pb_shift"))).alias("pvt_shift"),
    )


def checked_shift(shift):
    """The PVT grid must keep rising: a shift at or below 14.7 - 400 psi would
    move the first shifted node onto the anchor, so such a run fails the job."""
    return F.when(pvt.shift_is_valid(shift), shift).otherwise(
        F.raise_error(F.format_string("pb_shift %s would reorder the PVT grid", shift.cast("string"))))


def normalize_units(wide: DataFrame) -> DataFrame:
    """Vector columns (deck units) + unit_system -> trajectory columns in FIELD units."""
    u = F.col("unit_system")
    cols = [units.to_field(F.col(k), u, k).alias(units.VECTOR_COLUMNS[k]) for k in SUMMARY_KEYS]
    keep = [c for c in wide.columns if c not in SUMMARY_KEYS]
    return wide.select(*keep, *cols)


def with_pvt(df: DataFrame, pressure: str = "Presion_Reservorio_psi", shift: str = "pvt_shift") -> DataFrame:
    p, s = F.col(pressure), F.col(shift)
    return df.withColumns({
        "Bo_rb_stb": pvt.bo_from_pressure(p, s),
        "Bg_rb_scf": pvt.bg_from_pressure(p),
        "Rs_scf_stb": pvt.rs_from_pressure(p, s),
    })


def feature_table(vectors: DataFrame, levers: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Join each run's scalars onto its steps, normalise units, derive PVT.

    The join is on the run key; the run table has one row per run, so AQE
    broadcasts it when small and splits a skewed run otherwise. ``runs``
    (optional) restricts the result to those runs by filtering the small run
    table before the one join, instead of a second join on the big side.
    """
    wide = pivot_summary_vectors(vectors)
    rf = run_features(levers)
    if runs is not None:
        rf = rf.join(runs.select(*RUN_KEY), RUN_KEY, "left_semi")
    joined = wide.join(rf, RUN_KEY, "inner")
    return with_pvt(normalize_units(joined)).select(*TRAJECTORY_COLUMNS, "step")
