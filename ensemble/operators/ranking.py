"""Ranks, running sums, lags and quantiles without one task per (possibly huge) group.

A window ``partitionBy(sim).orderBy(t)`` puts a whole simulation in one task;
if one simulation holds a third of all rows that task holds a third of the
data. Here every group is cut into contiguous chunks of its order: the bounds
are approximate quantiles of the first order column over *all* rows, so no
(group, chunk) can hold more than about one chunk's share of the table,
whichever group it belongs to. Per-chunk totals, prefix sums over them and a
window inside each chunk give exactly what the plain window gives. There is one
path for all sizes, and nothing is counted while a plan is built: the number of
chunks is an expression over the table's row count.

NULLs behave as in the plain window: rows with a NULL group key form a group,
a NULL order value comes first, and a running sum is NULL until a value was seen.
Rows that are equal in the first order column share a chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK, _KEY = "__chunk", "__group_chunk"

#: Rows one chunk should hold, if MAX_CHUNKS of them cover the table.
ROWS_PER_CHUNK = 1_000_000
#: Most chunks the order is cut into (a power of two): one holds about 1 / MAX_CHUNKS of all rows or ROWS_PER_CHUNK.
LEVELS = 12
MAX_CHUNKS = 1 << LEVELS


def _chunked(df: DataFrame, order_col: str, rows_per_chunk: int) -> DataFrame:
    """Adds the chunk of every row: its place among the cuts of the order column.

    The cuts are as many of the approximate quantiles as there are chunks, less
    one; a row finds its place by halving (``LEVELS`` array reads, compiled code).
    """
    probs = [i / MAX_CHUNKS for i in range(1, MAX_CHUNKS)]
    x = F.col(order_col)
    stats = df.agg(F.percentile_approx(x, probs, 10 * MAX_CHUNKS).alias("__all"), F.count(F.lit(1)).alias("__rows"))
    chunks = F.least(F.greatest(F.ceil(F.col("__rows") / F.lit(rows_per_chunk)), F.lit(1)), F.lit(MAX_CHUNKS))
    at = F.transform(F.sequence(F.lit(1), F.lit(MAX_CHUNKS)), lambda i: F.floor(i * F.lit(MAX_CHUNKS) / F.col("__chunks")))
    cuts = F.when(F.col("__chunks") > 1, F.transform(F.slice(at, F.lit(1), F.col("__chunks") - 1), lambda i: F.get("__all", i - 1)))
    stats = stats.withColumn("__chunks", chunks.cast("int")).select(cuts.alias("__cuts"))
    out = df.crossJoin(F.broadcast(stats)).withColumn(_CHUNK, F.lit(0))  # one row
    for level in reversed(range(LEVELS)):
        more = F.coalesce(F.get("__cuts", F.col(_CHUNK) + F.lit((1 << level) - 1)) < x, F.lit(False))
        out = out.withColumn(_CHUNK, F.col(_CHUNK) + F.when(more, F.lit(1 << level)).otherwise(F.lit(0)))
    return out.drop("__cuts")


def _with_totals(staged: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-chunk totals back, NULL keys included."""
    right = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in totals.columns if c not in keys])
    cond = None
    for k in keys:
        same = staged[k].eqNullSafe(right[f"__k_{k}"])
        cond = same if cond is None else cond & same
    return staged.join(right, cond).drop(*[f"__k_{k}" for k in keys])


def _order_value(df: DataFrame, order_cols: Sequence[str]) -> Column:
    """What the last row of a chunk has most of. One number, where there is one order column,
    keeps the aggregation in a hash table; a struct of several columns needs a sorted one."""
    kind = df.schema[order_cols[0]].dataType
    lowest = {"bigint": -(1 << 63), "int": -(1 << 31), "double": float("-inf")}.get(kind.simpleString())
    if len(order_cols) == 1 and lowest is not None:
        return F.coalesce(F.col(order_cols[0]), F.lit(lowest).cast(kind))
    return F.struct(*[F.col(c) for c in order_cols])


def global_rank(df: DataFrame, order_col: str, tie_cols: Sequence[str], *,
                partition_cols: Sequence[str] = (), rank_col: str = "rank",
                rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """0-based rank of each row by (order_col, *tie_cols) within partition_cols."""
    return ordered_scan(df, partition_cols, [order_col, *tie_cols], index_col=rank_col, rows_per_chunk=rows_per_chunk)


def ordered_scan(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], *,
                 index_col: str | None = None,
                 running_sums: Mapping[str, str] | None = None,
                 previous: Mapping[str, str] | None = None,
                 carried: Mapping[str, str] | None = None,
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per group, in (order_cols) order: 0-based index, running sums, previous and carried values.

    ``running_sums`` maps output -> input column (inclusive running sum);
    ``previous`` maps output -> input column (value of the row before, NULL on
    the first row of the group); ``carried`` maps output -> input column (its last
    value that is not NULL, at the row or before). The first order column is numeric.
    """
    running_sums, previous, carried = dict(running_sums or {}), dict(previous or {}), dict(carried or {})
    group = list(group_cols)
    # group and chunk as one key that is never NULL: window and join share its one shuffle and sort
    staged = _chunked(df, order_cols[0], rows_per_chunk).withColumn(_KEY, F.struct(*[F.col(c) for c in group], F.col(_CHUNK)))
    last = _order_value(df, order_cols)
    totals = staged.groupBy(_KEY).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(src).alias(f"__tot_{o}") for o, src in running_sums.items()],
        *[F.max_by(F.col(src), last).alias(f"__last_{o}") for o, src in previous.items()],
        *[F.max_by(F.col(src), F.when(F.col(src).isNotNull(), last)).alias(f"__some_{o}") for o, src in carried.items()])
    w_chunks = Window.partitionBy(*[F.col(f"{_KEY}.{c}") for c in group]).orderBy(F.col(f"{_KEY}.{_CHUNK}"))
    w_before = w_chunks.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        _KEY, F.coalesce(F.sum("__n").over(w_before), F.lit(0)).alias("__off_n"),
        *[F.sum(f"__tot_{o}").over(w_before).alias(f"__off_{o}") for o in running_sums],
        *[F.lag(f"__last_{o}").over(w_chunks).alias(f"__prev_{o}") for o in previous],
        *[F.last(f"__some_{o}", ignorenulls=True).over(w_before).alias(f"__from_{o}") for o in carried])
    w = Window.partitionBy(_KEY).orderBy(*[F.col(c) for c in order_cols])
    w_run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # all frames in one window, before the join
    out = staged.select("*", F.row_number().over(w).alias("__rn"),
                        *[F.sum(src).over(w_run).alias(f"__in_{o}") for o, src in running_sums.items()],
                        *[F.lag(src).over(w).alias(f"__lag_{o}") for o, src in previous.items()],
                        *[F.last(src, ignorenulls=True).over(w_run).alias(f"__own_{o}") for o, src in carried.items()]).join(totals, _KEY)
    cols = []
    if index_col:
        cols.append((F.col("__off_n") + F.col("__rn") - 1).cast("long").alias(index_col))
    for o in running_sums:
        inside, offset = F.col(f"__in_{o}"), F.col(f"__off_{o}")
        cols.append(F.when(inside.isNull(), offset).otherwise(inside + F.coalesce(offset, F.lit(0))).alias(o))
    for o in previous:
        cols.append(F.when(F.col("__rn") == 1, F.col(f"__prev_{o}")).otherwise(F.col(f"__lag_{o}")).alias(o))
    cols += [F.coalesce(f"__own_{o}", f"__from_{o}").alias(o) for o in carried]
    new = {index_col, *running_sums, *previous, *carried}
    return out.select(*[F.col(c) for c in df.columns if c not in new], *cols)


#: Accuracy of the approximate quantiles that bracket an exact one (rank error at most 1 / ACCURACY).
ACCURACY = 10_000


def exact_quantiles(long: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Sequence[float], few_groups: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / ``percentile``), per group.

    Two passes. The first gives, per group, the count and approximate quantiles
    just below and above each wanted one, which bracket it for certain. The
    second counts the values of each bracket (all below it as one), so only
    about 4 / ACCURACY of the values, and of equal values one row, are shuffled
    and put in order. NULLs are ignored. Returns (group_cols..., q, value).
    With ``few_groups`` the brackets are broadcast, so that the values stay where they are.
    """
    group = list(group_cols)
    v = F.col("__v")
    vals = long.where(F.col(value_col).isNotNull()).select(*group, F.col(value_col).alias("__v"))
    margin = 2.0 / ACCURACY
    low = [max(0.0, q - margin) for q in probs]
    high = [min(1.0, q + margin) for q in probs]
    stats = vals.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"),
                                     F.percentile_approx(v, low, ACCURACY).alias("__low"),
                                     F.percentile_approx(v, high, ACCURACY).alias("__high"),
                                     F.min(v).alias("__min"), F.max(v).alias("__max"))
    few = F.col("__n") < ACCURACY  # the margin is less than two ranks: the bracket is the whole group
    wanted = F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("q"),
                 F.when(few | F.lit(low[i] == 0.0), F.col("__min")).otherwise(F.get("__low", i)).alias("lo"),
                 F.when(few | F.lit(high[i] == 1.0), F.col("__max")).otherwise(F.get("__high", i)).alias("hi"))
        for i, q in enumerate(probs)]))
    brackets = stats.select(*group, "__n", wanted.alias("__w")).select(
        *group, "__n", "__w.q", F.col("__w.lo").alias("__lo"), F.col("__w.hi").alias("__hi"))
    if few_groups:
        brackets = F.broadcast(brackets)
    near = (_with_totals(vals, brackets, group) if group else vals.crossJoin(brackets)) \
        .where(v <= F.col("__hi")).withColumn("__v", F.when(v >= F.col("__lo"), v))  # NULL: below the bracket
    counts = near.groupBy(*group, "q", "__v").agg(F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n"))
    w = Window.partitionBy(*group, "q").orderBy(F.col("__v").asc_nulls_first())
    upto = counts.withColumn("__upto", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pos = F.col("q") * (F.col("__n") - 1)
    picked = upto.groupBy(*group, "q").agg(
        F.max("__n").alias("__n"),
        F.min(F.when(F.col("__upto") > F.floor(pos), v)).alias("__a"),
        F.min(F.when(F.col("__upto") > F.ceil(pos), v)).alias("__b"))
    frac = pos - F.floor(pos)
    value = F.when(frac == 0, F.col("__a")).otherwise(F.col("__a") + (F.col("__b") - F.col("__a")) * frac)
    return picked.select(*group, "q", value.alias("value"))
