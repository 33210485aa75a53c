"""Unit normalisation to FIELD units and run-level derived scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BAR_TO_PSI, SM3_TO_MSCF, SM3_TO_SCF, SM3_TO_STB

# Factor applied to each summary vector, per unit system.
UNIT_FACTORS = {
    "METRIC": {
        "TIME": 1.0,
        "FPR": BAR_TO_PSI,
        "FOPR": SM3_TO_STB,
        "FGPR": SM3_TO_MSCF,
        "FWIR": SM3_TO_STB,
        "FOPT": SM3_TO_STB,
        "FGPT": SM3_TO_SCF,
        "FWPT": SM3_TO_STB,
        "FWIT": SM3_TO_STB,
    },
    # FIELD decks are already in field units, except cumulative gas (Mscf -> scf).
    "FIELD": {"FGPT": 1000.0},
}

#: Summary vector -> trajectory column.
VECTOR_COLUMNS = {
    "TIME": "tiempo_dias",
    "FPR": "Presion_Reservorio_psi",
    "FOPR": "Caudal_Prod_Petroleo_bbl",
    "FGPR": "Caudal_Prod_Gas_Mpc",
    "FWIR": "Caudal_Iny_Agua_bbl",
    "FOPT": "Prod_Acumulada_Petroleo",
    "FGPT": "Prod_Acumulada_Gas",
    "FWPT": "Prod_Acumulada_Agua",
    "FWIT": "Iny_Acumulada_Agua",
}


def to_field(value: Column, unit_system: Column, key: str) -> Column:
    """``value`` of summary vector ``key`` converted to FIELD units."""
    metric = UNIT_FACTORS["METRIC"].get(key, 1.0)
    field = UNIT_FACTORS["FIELD"].get(key, 1.0)
    out = value
    if metric != 1.0:
        out = F.when(unit_system == "METRIC", value * F.lit(metric)).otherwise(out)
    if field != 1.0:
        out = F.when(unit_system == "FIELD", value * F.lit(field)).otherwise(out)
    return out


def bubble_point_psi(unit_system: Column, baseline_pb: Column,
                     pb_shift: Column, p_init_shift_bar: Column) -> Column:
    """Shifted bubble point in psi; a lever the reservoir lacks counts as 0."""
    metric = (baseline_pb + F.coalesce(p_init_shift_bar, F.lit(0.0))) * F.lit(BAR_TO_PSI)
    field = baseline_pb + F.coalesce(pb_shift, F.lit(0.0))
    return F.when(unit_system == "METRIC", metric).otherwise(field)


def pvt_shift(unit_system: Column, pb_shift: Column) -> Column:
    """Shift applied to the PVT grid: METRIC decks use the table unshifted."""
    return F.when(unit_system == "METRIC", F.lit(0.0)).otherwise(F.coalesce(pb_shift, F.lit(0.0)))
