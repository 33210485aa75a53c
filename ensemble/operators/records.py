"""Records of keyword files: items up to ``/``, over lines, with repeat counts, typed by keyword.

A record is what stands between two terminators of a section: its items may lie on
several lines, ``N*value`` stands for N items and ``N*`` for N defaults (NULL),
quoted items may hold blanks, slashes and stars, ``--`` begins a comment and what
follows ``/`` on a line is one too. Nothing is gathered: an item is a row with its
place in the record, from running sums of items and terminators over the file's
lines, and a repeat stays one row with its count; so a grid property of millions
of values in one record is as many small rows in as many tasks as its lines have.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import ordered_scan
from .text import numbered_lines, scan_keyword_files

#: What a line holds before its terminator or comment: quoted items, or anything but quotes, slashes and ``--``.
_BODY = r"^((?:'[^']*+'|[^'/-]++|-(?!-))*+)"
_ITEM = r"'[^']*'|[^\s']+"

# The items of the control keywords, in their order, with their types.
KEYWORD_ITEMS: dict[str, tuple[tuple[str, str], ...]] = {
    "EQUIL": (("datum", "double"), ("pressure", "double"), ("woc", "double"), ("pcow", "double"), ("goc", "double"),
              ("pcog", "double"), ("rsvd", "int"), ("rvvd", "int"), ("acc", "int")),
    "WCONINJE": (("well", "string"), ("fluid", "string"), ("status", "string"), ("mode", "string"), ("rate", "double")),
    "WCONPROD": (("well_pattern", "string"), ("status", "string"), ("mode", "string"), ("rate", "double")),
    "GCONINJE": (("grp", "string"), ("phase", "string"), ("mode", "string"), ("rate", "double")),
}


def line_items(line: Column, header: Column) -> tuple[Column, Column]:
    """(items of a line as an array of (repeat, value), whether it ends a record); nothing of headers."""
    body = F.regexp_extract(line, _BODY, 1)
    ends = header.isNull() & (F.substring(F.substr(line, F.length(body) + 1), 1, 1) == "/")
    tokens = F.when(header.isNull(), F.regexp_extract_all(body, F.lit(_ITEM), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def item(t: Column) -> Column:
        repeat, rest = F.regexp_extract(t, r"^(\d+)\*", 1), F.regexp_replace(t, r"^\d+\*", "")
        value = F.when(t.startswith("'"), F.substr(t, F.lit(2), F.length(t) - 2)).when(rest != "", F.regexp_replace(rest, "'", ""))
        return F.struct(F.coalesce(repeat.try_cast("long"), F.lit(1)).alias("repeat"), value.alias("value"))
    return F.transform(tokens, item), F.coalesce(ends, F.lit(False))


def record_items(raw: DataFrame, header: Column | None = None) -> DataFrame:
    """Lines of split files -> (file, section, section_no, record, lineno, start, repeat, value): each item with the
    place (from 0) of the first of its repeats in its record. ``record`` rises inside a file; empty records have no rows."""
    items, ends = line_items(F.col("line"), F.col("__hdr"))
    count = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["repeat"])
    lines = numbered_lines(raw, header, sums={"items_upto": count, "ends_upto": ends.cast("int")}) \
        .withColumn("__it", items).withColumn("record", F.col("ends_upto") - ends.cast("int")).where(F.size("__it") > 0) \
        .withColumn("__before", F.col("items_upto") - F.aggregate("__it", F.lit(0).cast("long"), lambda a, x: a + x["repeat"]))
    key = ["file", "section_no", "record"]
    begins = lines.groupBy(*key).agg(F.min("__before").alias("__begin"))
    placed = F.transform("__it", lambda x, i: F.struct(
        F.aggregate(F.slice("__it", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["repeat"]).alias("skip"),
        x["repeat"].alias("repeat"), x["value"].alias("value")))
    return lines.join(begins, key).select(*key, "section", "lineno", (F.col("__before") - F.col("__begin")).alias("__at"), F.inline(placed)) \
        .select("file", "section", "section_no", "record", "lineno", (F.col("__at") + F.col("skip")).alias("start"), "repeat", "value")


def expanded_items(items: DataFrame) -> DataFrame:
    """A row for each repeat: (file, section, section_no, record, item, value)."""
    return items.select("file", "section", "section_no", "record",
                        F.explode(F.sequence(F.col("start"), F.col("start") + F.col("repeat") - 1)).alias("item"), "value") \
        .where("item is not null")


def typed_records(items: DataFrame, keyword: str) -> DataFrame:
    """(file, record_no, the keyword's items...) of all records of a keyword, numbered from 1 through its file.
    Items that a record leaves out, and values that are not of the item's type, are NULL."""
    fields = KEYWORD_ITEMS[keyword]
    pick = [F.max(F.when((F.col("start") <= k) & (F.lit(k) < F.col("start") + F.col("repeat")), F.col("value"))).try_cast(kind).alias(name)
            for k, (name, kind) in enumerate(fields)]
    rows = items.where(F.col("section") == keyword).groupBy("file", "section_no", "record").agg(F.min("lineno").alias("lineno"), *pick)
    return ordered_scan(rows, ["file"], ["lineno"], index_col="__no").select(
        "file", (F.col("__no") + 1).cast("int").alias("record_no"), *[n for n, _ in fields])


def control_tables(raw: DataFrame) -> Mapping[str, DataFrame]:
    """The control tables that the scenario rules change, from keyword files in folders named after their reservoirs.

    Items and tables are checkpointed (in the shared folder): every rule reads its table more than once.
    """
    items = cut_lineage(record_items(raw).where(F.col("section").isin(list(KEYWORD_ITEMS))))
    reservoir = F.regexp_extract("file", r"([a-z0-9]+)/[^/]*$", 1).alias("reservoir_id")

    def table(keyword: str) -> DataFrame:
        return cut_lineage(typed_records(items, keyword).select(reservoir, "record_no", *[n for n, _ in KEYWORD_ITEMS[keyword]]))
    # the table rule works on lines: four numbers, or three on the line of an undersaturated point
    pvto = scan_keyword_files(raw).where((F.col("section") == "PVTO") & (F.col("n_numbers") > 0))
    pvto = cut_lineage(ordered_scan(pvto, ["file"], ["lineno"], index_col="__no").select(
        reservoir, (F.col("__no") + 1).cast("int").alias("record_no"), F.col("numbers").alias("nums"), "terminated"))
    return {"injector": table("WCONINJE"), "producer": table("WCONPROD"), "equil": table("EQUIL"),
            "group_injection": table("GCONINJE"), "pvto": pvto}
