"""Piecewise-linear lookup as a Catalyst expression.

``interp(x, xs, ys)`` has the semantics of ``numpy.interp``: values left of the
first node take the first y, values right of the last node the last y, and in
between ``slope_j * (x - x_j) + y_j`` with ``slope_j = (y_{j+1} - y_j) /
(x_{j+1} - x_j)`` — the same operations in the same order, so results agree
bit for bit. Nodes may be literals or Columns (e.g. a grid shifted per run).
The result is a ``CASE WHEN`` chain: it stays inside whole-stage codegen and
needs no join against the table (a range join without an equi key would plan
as a broadcast nested loop).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def interp(x: Column, xs: Sequence, ys: Sequence) -> Column:
    if len(xs) != len(ys) or len(xs) < 2:
        raise ValueError("interp needs at least two (x, y) nodes of equal count")
    xs_c = [_c(v) for v in xs]
    ys_c = [_c(v) for v in ys]
    expr = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= xs_c[0], ys_c[0])
    for j in range(len(xs) - 1):
        slope = (ys_c[j + 1] - ys_c[j]) / (xs_c[j + 1] - xs_c[j])
        expr = expr.when(x < xs_c[j + 1], slope * (x - xs_c[j]) + ys_c[j])
    return expr.otherwise(ys_c[-1])


def segment_index(x: Column, xs: Sequence) -> Column:
    """Index j of the segment [x_j, x_{j+1}) holding x; -1 left, n-1 right of the table."""
    xs_c = [_c(v) for v in xs]
    expr = F.when(x.isNull(), F.lit(None).cast("int")).when(x < xs_c[0], F.lit(-1))
    for j in range(len(xs) - 1):
        expr = expr.when(x < xs_c[j + 1], F.lit(j))
    return expr.otherwise(F.lit(len(xs) - 1))
