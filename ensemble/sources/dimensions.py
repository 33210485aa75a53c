"""Small dimension tables built from the fixed values in :mod:`ensemble.schemas`.

Their size is fixed by the registry (3 reservoirs, 11 PVT rows, 15 layers), so
they are safe to broadcast: nothing about them grows with the ensemble.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import (ALL_LEVERS, LAYER_POROSITY, LAYER_THICKNESS_FT, PVDG, PVTO_SATURATED,
                       RESERVOIRS)

RESERVOIR_DIM = T.StructType(
    [T.StructField("reservoir_id", T.StringType(), False),
     T.StructField("unit_system", T.StringType(), False),
     T.StructField("baseline_pb", T.DoubleType(), False),
     T.StructField("baseline_porosity", T.DoubleType(), False),
     T.StructField("baseline_perm_md", T.DoubleType(), False),
     T.StructField("espesor_neto_m", T.DoubleType(), False),
     T.StructField("area_m2", T.DoubleType(), False),
     T.StructField("flow_timeout_s", T.DoubleType(), False),
     T.StructField("n_levers", T.IntegerType(), False)]
    + [T.StructField(f"{lv}_{end}", T.DoubleType(), True)
       for lv in ALL_LEVERS for end in ("lo", "hi")]
)


def reservoir_dim(spark: SparkSession) -> DataFrame:
    """One row per registered reservoir; lever ranges as nullable ``<lever>_lo/_hi``."""
    rows = []
    for name in sorted(RESERVOIRS):
        cfg = RESERVOIRS[name]
        row = [name, cfg["unit_system"], float(cfg["baseline_pb"]), float(cfg["baseline_porosity"]),
               float(cfg["baseline_perm_md"]), float(cfg["espesor_neto_m"]), float(cfg["area_m2"]),
               float(cfg["flow_timeout_s"]), len(cfg["levers"])]
        for lv in ALL_LEVERS:
            lo_hi = cfg["levers"].get(lv)
            row += [float(lo_hi[0]), float(lo_hi[1])] if lo_hi else [None, None]
        rows.append(tuple(row))
    return F.broadcast(spark.createDataFrame(rows, RESERVOIR_DIM))


def lever_ranges(spark: SparkSession) -> DataFrame:
    """Long form (reservoir_id, lever, lever_pos, lo, hi)."""
    rows = [(name, lv, i, float(lo), float(hi))
            for name, cfg in sorted(RESERVOIRS.items())
            for i, (lv, (lo, hi)) in enumerate(cfg["levers"].items())]
    schema = "reservoir_id string, lever string, lever_pos int, lo double, hi double"
    return F.broadcast(spark.createDataFrame(rows, schema))


def pvt_tables(spark: SparkSession) -> DataFrame:
    """Segments of both PVT tables: (table_id, seg, x0, x1, y0, y1)."""
    rows = []
    tables = {
        "pvto_rs": [(r[1], r[0] * 1000.0) for r in PVTO_SATURATED],
        "pvto_bo": [(r[1], r[2]) for r in PVTO_SATURATED],
        "pvdg_bg": [(r[0], r[1] / 1000.0) for r in PVDG],
    }
    for tid, pts in tables.items():
        for j in range(len(pts) - 1):
            rows.append((tid, j, pts[j][0], pts[j + 1][0], pts[j][1], pts[j + 1][1]))
    schema = "table_id string, seg int, x0 double, x1 double, y0 double, y1 double"
    return F.broadcast(spark.createDataFrame(rows, schema))


def layers(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, float(h), float(p)) for i, (h, p) in enumerate(zip(LAYER_THICKNESS_FT, LAYER_POROSITY))]
    return F.broadcast(spark.createDataFrame(rows, "layer int, thickness_ft double, porosity double"))


# ---------------------------------------------------------------------------
# Baseline control records of the decks (the records scenario
# rules rewrite). The main deck of the third field is not available; its
# equilibration and group-injection records below are illustrative only.
# ---------------------------------------------------------------------------
INJECTOR_RECORDS = [("spe9", 1, "INJE1", "WATER", "OPEN", "RATE", 5000.0)]
PRODUCER_RECORDS = [
    ("spe9", 1, "PRODU*", "OPEN", "ORAT", 1500.0),
    ("spe9", 2, "PRODU*", "OPEN", "ORAT", 100.0),
    ("spe9", 3, "PRODU*", "OPEN", "ORAT", 1500.0),
]
EQUIL_RECORDS = [
    ("spe9", 1, 9035.0, 3600.0, 9950.0, 0.0, 8800.0, 0.0, 1, 0, 0),
    ("norne", 1, 2582.0, 268.56, 2692.0, 0.0, 2582.0, 0.0, 1, 0, 0),
    ("norne", 2, 2500.0, 263.41, 2585.5, 0.0, 2500.0, 0.0, 2, 0, 0),
    ("norne", 3, 2582.0, 269.46, 2618.0, 0.0, 2582.0, 0.0, 3, 0, 0),
    ("norne", 4, 2200.0, 236.92, 2400.0, 0.0, 2200.0, 0.0, 4, 0, 0),
    ("norne", 5, 2585.0, 268.77, 2693.3, 0.0, 2585.0, 0.0, 5, 0, 0),
] + [("volve", i, 2900.0 + 10.0 * i, 320.0 + 0.5 * i, 3100.0, 0.0, 2900.0, 0.0, i, 0, 0)
     for i in range(1, 13)]
#: PVTO records of the light-oil deck: numbers per line, trailing '/' or not.
PVTO_RECORDS = [
    (1, [0.0, 14.7, 1.0, 1.20], True),
    (2, [0.165, 400.0, 1.0120, 1.17], True),
    (3, [0.335, 800.0, 1.0255, 1.14], True),
    (4, [0.500, 1200.0, 1.0380, 1.11], True),
    (5, [0.665, 1600.0, 1.0510, 1.08], True),
    (6, [0.828, 2000.0, 1.0630, 1.06], True),
    (7, [0.985, 2400.0, 1.0750, 1.03], True),
    (8, [1.130, 2800.0, 1.0870, 1.00], True),
    (9, [1.270, 3200.0, 1.0985, 0.98], True),
    (10, [1.390, 3600.0, 1.1100, 0.95], True),
    (11, [1.500, 4000.0, 1.1200, 0.94], False),
    (12, [5000.0, 1.1189, 0.94], True),
]
GROUP_INJECTION_RECORDS = [
    ("volve", 1, "FIELD", "WAT", "RATE", 9000.0),
    ("volve", 2, "FIELD", "WAT", "RATE", 7000.0),
    ("volve", 3, "FIELD", "GAS", "RATE", 1000.0),
]
GRID_PROPERTIES = ["PORO", "PERMX", "PERMY", "PERMZ"]


def control_table(spark: SparkSession, name: str) -> DataFrame:
    """Baseline control records by name (fixed size: safe to broadcast)."""
    if name == "injector":
        df = spark.createDataFrame(INJECTOR_RECORDS, "reservoir_id string, record_no int, well string, "
                                   "fluid string, status string, mode string, rate double")
    elif name == "producer":
        df = spark.createDataFrame(PRODUCER_RECORDS, "reservoir_id string, record_no int, well_pattern string, "
                                   "status string, mode string, rate double")
    elif name == "equil":
        df = spark.createDataFrame(EQUIL_RECORDS, "reservoir_id string, record_no int, datum double, "
                                   "pressure double, woc double, pcow double, goc double, pcog double, "
                                   "rsvd int, rvvd int, acc int")
    elif name == "pvto":
        rows = [("spe9", n, [float(x) for x in nums], term) for n, nums, term in PVTO_RECORDS]
        df = spark.createDataFrame(rows, "reservoir_id string, record_no int, nums array<double>, "
                                   "terminated boolean")
    elif name == "group_injection":
        df = spark.createDataFrame(GROUP_INJECTION_RECORDS, "reservoir_id string, record_no int, "
                                   "grp string, phase string, mode string, rate double")
    elif name == "grid":
        # per layer of the light-oil deck: porosity, and the baseline permeability
        rows = []
        base_perm = RESERVOIRS["spe9"]["baseline_perm_md"]
        for i, p in enumerate(LAYER_POROSITY):
            for prop in GRID_PROPERTIES:
                rows.append(("spe9", i + 1, prop, float(p) if prop == "PORO" else float(base_perm)))
        df = spark.createDataFrame(rows, "reservoir_id string, cell long, prop string, value double")
    else:
        raise KeyError(f"unknown control table {name!r}")
    return F.broadcast(df)
