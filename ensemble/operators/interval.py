"""Piecewise-linear lookup in many tables: an as-of join of rows and nodes.

The expression form of a lookup writes a table's nodes into the plan and the tabular
form broadcasts them; neither holds for a table a run, or millions of tables. Here
rows and nodes are united and put in order of x inside each table, and the last node
at or before a row is carried to it, with the node after that one. The scan is cut
into chunks of x (:func:`ranking.ordered_scan`), so a table with a third of all rows is
not one task; nothing is broadcast and no range condition is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import ROWS_PER_CHUNK, ordered_scan


def segments(nodes: DataFrame, table_cols: Sequence[str], x: str = "x", y: str = "y", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """(table..., seg, x0, y0, x1, y1): from each node to the next one; the last node's x1 is NULL. Of nodes with
    the same x the one with the largest y stays (a table has one value at a place)."""
    keys = list(table_cols)
    one = nodes.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x0")) \
        .agg(F.max(F.col(y).cast("double")).alias("y0"))
    # the next node of a rising order is the one before it in a falling one
    back = ordered_scan(one.withColumn("__down", -F.col("x0")), keys, ["__down"], index_col="__from_end", previous={"x1": "x0", "y1": "y0"},
                        rows_per_chunk=rows_per_chunk)
    size = one.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return back.join(size, same).select(*keys, (F.col("__n") - 1 - F.col("__from_end")).cast("int").alias("seg"), "x0", "y0", "x1", "y1")


def interp_asof(rows: DataFrame, nodes: DataFrame, table_cols: Sequence[str], at: str, x: str = "x", y: str = "y",
                rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``rows`` with ``seg`` and ``value``: the table's value at ``at``, held at its ends as ``numpy.interp`` does.

    ``seg`` counts from 0; below the first node it is 0 and from the last node on it is the last segment (-1 in a
    table of one node). Rows whose ``at`` is NULL or whose table has no nodes get NULL.
    """
    keys = list(table_cols)
    segs = cut_lineage(segments(nodes, keys, x, y, rows_per_chunk))  # read by each pass below
    # what lies before the first node takes its value: a node of its own, before all
    first = segs.where("seg = 0").select(*keys, F.when(F.col("x1").isNull(), -1).otherwise(0).alias("seg"), F.lit(float("-inf")).alias("x0"), "y0", F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    node = F.struct("seg", "x0", "y0", "x1", "y1").alias("__node")
    marks = segs.union(first).select(*keys, F.col("x0").alias("__x"), F.lit(0).alias("__kind"), node, F.lit(None).cast(rows.schema).alias("__row"))
    asked = rows.select(*keys, F.col(at).cast("double").alias("__x"), F.lit(1).alias("__kind"), F.lit(None).cast(_type(marks, "__node")).alias("__node"),
                        F.struct(*rows.columns).alias("__row"))
    found = ordered_scan(marks.union(asked), keys, ["__x", "__kind"], carried={"__at": "__node"}, rows_per_chunk=rows_per_chunk) \
        .where("__kind = 1").select("__row.*", "__x", "__at.*")
    p = F.col("__x")
    inside = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")) * (p - F.col("x0")) + F.col("y0")
    value = F.when(p.isNotNull(), F.when((F.col("x0") == float("-inf")) | F.col("x1").isNull(), F.col("y0")).otherwise(inside))
    seg = F.when(p.isNotNull(), F.when(F.col("x1").isNull(), F.col("seg") - 1).otherwise(F.col("seg")))
    return found.select(*rows.columns, seg.alias("seg"), value.alias("value"))


def _type(df: DataFrame, name: str):
    return df.schema[name].dataType
