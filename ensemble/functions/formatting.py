"""Labels and report formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def run_label(reservoir_id: Column, sim_id: Column) -> Column:
    """``<reservoir>_sim_<NNNN>``."""
    return F.format_string("%s_sim_%04d", reservoir_id, sim_id)


def psi(value: Column) -> Column:
    """``12.34 psi`` (format_string needs a double, not a decimal)."""
    return F.format_string("%.2f psi", value.cast("double"))


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def percent(value: Column, digits: int = 3) -> Column:
    """Fraction as a percentage, e.g. 0.0121 -> ``1.210%``."""
    return F.format_string(f"%.{digits}f%%", (value * F.lit(100.0)).cast("double"))
