"""Seeded, engine-independent pseudo-random numbers from column values.

``hash_uniform(seed, *cols)`` takes the first 52 bits of the MD5 of the
``|``-joined values and scales them to [0, 1). Any engine with md5 and base-16
parsing computes the same bits, so a seed gives the same draws everywhere and
on every re-execution of a task (no dependence on partitioning).
Pass integers or strings only: double-to-string formatting differs between engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(2 ** 52)


def _as_col(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.lit(c)


def hash_key(seed: int, *cols) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[_as_col(c).cast("string") for c in cols])


def hash_uniform(seed: int, *cols) -> Column:
    """Uniform double in [0, 1) derived from (seed, cols)."""
    hex13 = F.substring(F.md5(hash_key(seed, *cols)), 1, 13)
    return F.conv(hex13, 16, 10).cast("double") / F.lit(_TWO_52)

