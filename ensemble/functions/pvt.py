"""Fluid properties from reservoir pressure (column expressions, no UDF).

* Rs: saturated curve on the shifted grid, pressure clamped at the shifted
  bubble point, in scf/stb.
* Bo: saturated curve below the shifted bubble point; above it, a line to the
  fixed undersaturated point, continued past that point — unless the shifted
  bubble point is already at or above it, in which case Bo stays flat.
* Bg: clamped lookup of the gas table, rb/scf.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PVDG, PVT_ANCHOR_PSI, PVTO_SATURATED, PVTO_UNDERSAT
from .interp import interp

_GRID = [row[1] for row in PVTO_SATURATED]
_RS_MSCF = [row[0] for row in PVTO_SATURATED]
_BO = [row[2] for row in PVTO_SATURATED]
#: Smallest shift that keeps the grid strictly rising above the anchor.
MIN_PB_SHIFT = PVT_ANCHOR_PSI - _GRID[1]


def _shift(pb_shift) -> Column:
    return pb_shift if isinstance(pb_shift, Column) else F.lit(float(pb_shift))


def shifted_grid(pb_shift) -> list[Column]:
    """Saturation pressures with the shift added to every node above the anchor."""
    s = _shift(pb_shift)
    return [F.lit(x) if not x > PVT_ANCHOR_PSI else F.lit(x) + s for x in _GRID]


def shifted_grid_array(pb_shift) -> Column:
    """Array form: ``transform(grid, x -> x > 14.7 ? x + shift : x)``."""
    s = _shift(pb_shift)
    grid = F.array(*[F.lit(x) for x in _GRID])
    return F.transform(grid, lambda x: F.when(x > F.lit(PVT_ANCHOR_PSI), x + s).otherwise(x))


def pb_max(pb_shift) -> Column:
    return F.lit(_GRID[-1]) + _shift(pb_shift)


def shift_is_valid(pb_shift) -> Column:
    return _shift(pb_shift) > F.lit(MIN_PB_SHIFT)


def rs_from_pressure(p: Column, pb_shift=0.0) -> Column:
    grid = shifted_grid(pb_shift)
    p_eff = F.least(p, pb_max(pb_shift))
    return interp(p_eff, grid, _RS_MSCF) * F.lit(1000.0)


def bo_from_pressure(p: Column, pb_shift=0.0) -> Column:
    grid = shifted_grid(pb_shift)
    top = pb_max(pb_shift)
    bo_sat = interp(F.least(p, top), grid, _BO)
    p_us, bo_us = PVTO_UNDERSAT
    slope = (F.lit(bo_us) - F.lit(_BO[-1])) / (F.lit(p_us) - top)
    above = (p > top) & (F.lit(p_us) > top)
    return F.when(above, F.lit(_BO[-1]) + slope * (p - top)).otherwise(bo_sat)


def bg_from_pressure(p: Column) -> Column:
    return interp(p, [r[0] for r in PVDG], [r[1] for r in PVDG]) / F.lit(1000.0)
