"""Shared helpers for registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Significant digits kept in compared results.
SIGNIFICANT = 10


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to ``SIGNIFICANT`` digits (float sums depend on
    addition order) and widen small integers to BIGINT; ``+ 0.0`` turns a
    negative zero into zero so both engines hash the same value."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_significant(F.col(f.name).cast("double")).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _digits(c, sig: int):
    """Decimals that keep ``sig`` significant digits, at most 12."""
    return F.least(F.lit(sig - 1) - F.floor(F.log10(F.abs(c))), F.lit(12))


def round_significant(c):
    """Round to ``SIGNIFICANT`` significant digits: ``floor(x * 10^k + 0.5) / 10^k``.

    Plain IEEE steps, so engines that computed the same bits get the same
    result (decimal-based ``round`` breaks ties differently between engines),
    and a relative quantum, so large aggregates computed by different
    summation orders still compare equal.
    """
    scale = F.pow(F.lit(10.0), _digits(c, SIGNIFICANT))
    r = F.floor(c * scale + F.lit(0.5)) / scale + F.lit(0.0)
    return F.when((c == 0) | c.isNull() | F.isnan(c), c + F.lit(0.0)).otherwise(r)


def round_sql(inner: str, double_cols: str | list[str]) -> str:
    """Wrap a DuckDB query, rounding the named double columns."""
    cols = double_cols.split() if isinstance(double_cols, str) else list(double_cols)
    if not cols:
        return inner
    def one(c):
        k = f"least({SIGNIFICANT - 1} - floor(log10(abs({c}))), 12)"
        sc = f"pow(CAST(10.0 AS DOUBLE), {k})"
        return (f"CASE WHEN {c} = 0 OR {c} IS NULL OR isnan({c}) THEN {c} + CAST(0.0 AS DOUBLE)"
                f" ELSE floor({c} * {sc} + CAST(0.5 AS DOUBLE)) / {sc} + CAST(0.0 AS DOUBLE) END AS {c}")
    rep = ", ".join(one(c) for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) q"
