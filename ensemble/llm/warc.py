"""WARC records and Merkle fixity audits (operator 9).

Pages become WARC resource records, put one after the other into archives of a
fixed number of page ids; a record's place is its offset in its archive. A
Merkle tree stands over each archive: leaves hash a record with its offset range
and bytes, inner nodes hash the digests of ``FAN`` consecutive nodes with the
range they span. Two replicas of an archive are compared root by root; only
under mismatching nodes are the next lower ones compared, down to the records
that differ. An audit so reads as many digests as there is damage, times the
depth.

Defined cases: a null url or html is empty; a null page_id lies in an archive of
its own (-1); records of an archive are ordered by page_id, then by digest, and
repeated rows are repeated records; empty tables give no records; an archive
that only one replica has differs in every record; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Page ids per archive, children per tree node.
PER_ARCHIVE, FAN = 1024, 16


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC/1.1 resource record, up to its closing empty lines."""
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"),
                    F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, html, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """archive, page_id, record (text) of every page."""
    number = F.col("page_id").cast("long")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return pages.select(F.coalesce(F.floor(number / PER_ARCHIVE), F.lit(-1)).cast("long").alias("archive"), number.alias("page_id"),
                        record_text(F.coalesce(number, F.lit(-1)), text("url"), text("html")).alias("record"))


def damaged(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) of a copy of the pages that is damaged by a fixed rule over the whole table: by a number
    from the hash of its id, one page of 16 has its letters changed (at the same length), one of 256 is dropped,
    and one of 256 has a second record. Null ids are left as they are."""
    n = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 4), 16, 10).cast("int")
    rule = lambda mod, rest: F.coalesce(n % mod == rest, F.lit(False))
    html = F.when(rule(16, 0), F.translate("html", "e", "a")).otherwise(F.col("html"))
    kept = pages.filter(~rule(256, 1)).select("page_id", "url", html.alias("html"))
    added = pages.filter(rule(256, 2)).select("page_id", F.concat("url", F.lit("#copy")).alias("url"), "html")
    return kept.union(added)


def write_archives(pages: DataFrame, path: str) -> None:
    """WARC files in Spark's folder layout, a folder for each archive, its records in order of page_id."""
    rows = records(pages)
    # the closing empty lines of a record are the writer's line separator
    bare = rows.select("archive", "page_id", F.expr("substring(record, 1, length(record) - 4)").alias("value"))
    bare.repartition("archive").sortWithinPartitions("archive", "page_id").drop("page_id") \
        .write.partitionBy("archive").option("lineSep", "\r\n\r\n").option("compression", "none").text(path)


def leaves(rows: DataFrame) -> DataFrame:
    """archive, leaf, page_id, start, end, digest: the records' places and hashes (only these are shuffled)."""
    small = rows.select("archive", "page_id", F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("record_sha256"))
    w = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), "record_sha256")
    placed = small.withColumn("leaf", F.row_number().over(w) - 1) \
        .withColumn("end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.select("archive", "leaf", "page_id", (F.col("end") - F.col("size")).alias("start"), "end", "record_sha256") \
        .withColumn("digest", F.sha2(F.concat_ws(":", F.lit("leaf"), "start", "end", "record_sha256"), 256))


def tree(leaf_rows: DataFrame) -> list[DataFrame]:
    """Levels (archive, node, start, end, digest), from the leaves to one root for each archive."""
    levels = [leaf_rows.select("archive", F.col("leaf").cast("long").alias("node"), "start", "end", "digest")]
    widest = leaf_rows.agg(F.max("leaf")).first()[0] or 0
    while widest > 0:
        below = levels[-1].withColumn("up", F.floor(F.col("node") / FAN))
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"]), "")
        levels.append(below.groupBy("archive", "up").agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(F.concat_ws(":", F.lit("node"), F.min("start"), F.max("end"), parts), 256)
            .alias("digest")).select("archive", F.col("up").alias("node"), "start", "end", "digest"))
        widest //= FAN
    return levels


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """archive, leaf, status of the leaves that differ between two replicas' leaf tables.

    status: ``changed``, ``missing`` (the other replica lacks it) or ``extra``.
    Levels are compared from the roots; a level's rows are joined only under the
    nodes that differ one level above.
    """
    a, b = tree(one), tree(other)
    while len(a) < len(b):  # a smaller tree is carried up as it is
        a.append(a[-1])
    while len(b) < len(a):
        b.append(b[-1])
    suspect = None
    for level in range(len(a) - 1, -1, -1):
        x, y = a[level], b[level]
        if suspect is not None:
            up = suspect.select("archive", F.col("node").alias("up"))
            under = lambda t: t.withColumn("up", F.floor(F.col("node") / FAN)).join(up, ["archive", "up"], "left_semi")
            x, y = under(x), under(y)
        x, y = (t.select("archive", "node", F.col("digest").alias(n)) for t, n in ((x, "x"), (y, "y")))
        suspect = saved(x.join(y, ["archive", "node"], "full").filter(~F.col("x").eqNullSafe(F.col("y"))))
        if suspect.isEmpty():
            break
    return suspect.select("archive", F.col("node").alias("leaf"),
                          F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed").alias("status"))


def fixity(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, archive, start, end, record_sha256, root, status of every record of ``pages``.

    ``replica``: archive, page_id, record of the copy that is audited; records
    that only it has come with the status ``extra`` and its places.
    """
    one, other = saved(leaves(records(pages))), saved(leaves(replica))
    found = audit(one, other)
    roots = tree(one)[-1].select("archive", F.col("digest").alias("root"))
    mine = one.join(found, ["archive", "leaf"], "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    more = other.join(found.filter("status = 'extra'"), ["archive", "leaf"])
    return mine.unionByName(more).join(roots, "archive", "left").select(
        "page_id", "archive", F.col("start").alias("record_start"), F.col("end").alias("record_end"), "record_sha256", "root", "status")
