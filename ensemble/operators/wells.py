"""Per-well summary vectors across runs: catalogues, wide tables, run comparison.

Wide tables are conditional aggregations over fixed key lists: one
aggregation with map-side partial results, one shuffle.

Input: long well vectors (run, key_well, days, date, value) with keys such as
``WBHP:C-4H`` (vector ``WBHP`` of well ``C-4H``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors compared when none are named.
DEFAULT_VECTORS = ["WBHP", "WOPR", "WGPR", "WWPR"]
#: Runs that a comparison may lay side by side, a column each.
MAX_RUN_COLUMNS = 200


def split_key(df: DataFrame) -> DataFrame:
    """Adds ``vector`` and ``well`` from ``key_well``."""
    return df.withColumns({"vector": F.split_part(F.col("key_well"), F.lit(":"), F.lit(1)),
                           "well": F.split_part(F.col("key_well"), F.lit(":"), F.lit(2))})


def bhp_keys(df: DataFrame) -> DataFrame:
    """Keys that contain WBHP but not WBHPH (historical BHP is another vector)."""
    k = F.col("key_well")
    return df.where(k.contains("WBHP") & ~k.contains("WBHPH"))


def well_catalog(vectors: DataFrame) -> DataFrame:
    """Union over runs of the wells that report bottom-hole pressure: (well, n_runs)."""
    w = split_key(bhp_keys(vectors))
    return w.groupBy("well").agg(F.count_distinct("run").alias("n_runs"))


def key_catalog(vectors: DataFrame) -> DataFrame:
    """Distinct vector names over all runs: (vector, n_wells)."""
    return split_key(vectors).groupBy("vector").agg(F.count_distinct("well").alias("n_wells"))


def filter_selection(vectors: DataFrame, wells: Sequence[str] | None = None,
                     keys: Sequence[str] | None = None) -> DataFrame:
    """Keep the named wells / vectors; an empty or missing list keeps all."""
    v = split_key(vectors)
    if wells:
        v = v.where(F.col("well").isin(list(wells)))
    if keys:
        v = v.where(F.col("vector").isin(list(keys)))
    return v


def well_wide(vectors: DataFrame, keys: Sequence[str] = DEFAULT_VECTORS) -> DataFrame:
    """One row per (run, well, days, date), one column per vector."""
    v = filter_selection(vectors, keys=keys)
    return v.groupBy("run", "well", "days", "date").agg(
        *[F.avg(F.when(F.col("vector") == k, F.col("value"))).alias(k) for k in keys])


def run_labels(vectors: DataFrame, most: int = MAX_RUN_COLUMNS) -> list[str]:
    """The names of all runs in order. More than ``most`` cannot lie side by side: an error, not a cut."""
    names = [r.run for r in vectors.select("run").where(F.col("run").isNotNull()).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} runs: name those to compare")
    return sorted(names)


def run_comparison(vectors: DataFrame, runs: Sequence[str] | None = None, keys: Sequence[str] = DEFAULT_VECTORS) -> DataFrame:
    """Side by side per (well, vector, days): one column per run label (labels
    with ``_`` written as ``-``); without named ``runs``, all that occur."""
    v = filter_selection(vectors, keys=keys).withColumn("label", F.translate(F.col("run"), "_", "-"))
    labels = [r.replace("_", "-") for r in (run_labels(vectors) if runs is None else runs)]
    return v.groupBy("well", "vector", "days").agg(
        *[F.avg(F.when(F.col("label") == lb, F.col("value"))).alias(lb) for lb in labels])
