"""Keyword-section scans of text records and log tails.

``section_scan`` tags every line of a keyword file with the section it is in
(the last keyword header at or before it), drops blanks and ``--`` comments,
splits tokens, parses numbers and flags a trailing ``/`` terminator. The section
is carried forward inside chunks and from chunk to chunk, so one huge file is not
one task: chunks of an ordered scan where lines come from a table, the files'
own splits where they come from text files (``scan_keyword_files``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ordered_scan

#: A keyword header line: an upper-case word alone on its line.
KEYWORD_PATTERN = r"^[A-Z][A-Z0-9]*$"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace (tabs included, unlike ``trim``)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def keyword_header(line: Column) -> Column:
    t = strip(line)
    return F.when(t.rlike(KEYWORD_PATTERN), t)


def normalized_lines(c: Column) -> Column:
    """Text with ``\r\n`` and ``\r`` turned into ``\n`` and one final line break
    dropped, so that splitting on ``\n`` yields its lines. Literal replaces and
    a single-character split only: no regular expression runs over the text."""
    one = F.lit(1)
    body = (F.when(c.endswith("\r\n"), c.substr(one, F.length(c) - 2))
            .when(c.endswith("\n") | c.endswith("\r"), c.substr(one, F.length(c) - 1))
            .otherwise(c))
    return F.when(body.contains("\r"), F.replace(F.replace(body, F.lit("\r\n"), F.lit("\n")),
                                                 F.lit("\r"), F.lit("\n"))).otherwise(body)


def text_lines(df: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """Whole texts -> (file, lineno, line); one trailing line break ends the last line."""
    return df.select(F.col(file_col).alias("file"),
                     F.posexplode(F.split(normalized_lines(F.col(text_col)), "\n")).alias("lineno", "line"))


def _content(tagged: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """Content lines of lines with ``section`` and ``__hdr``, in tokens and numbers."""
    stripped = strip(F.col("line"))
    content = tagged.where(F.col("__hdr").isNull() & (stripped != "") & ~stripped.startswith("--"))
    terminated = stripped.endswith("/")
    body = strip(F.regexp_replace(stripped, r"/+$", ""))
    tokens = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\s+"))
    numbers = F.transform(tokens, lambda t: t.try_cast("double"))
    return content.select(
        "file", *order_cols, "section", "line", tokens.alias("tokens"), F.size(tokens).alias("n_tokens"),
        numbers.alias("numbers"), F.size(F.filter(numbers, lambda x: x.isNotNull())).alias("n_numbers"),
        terminated.alias("terminated"))


def section_scan(lines: DataFrame, header: Column | None = None, rows_per_chunk: int = 1_000_000,
                 order_cols: Sequence[str] = ("lineno",), order: Column | None = None) -> DataFrame:
    """lines(file, lineno, line[, ...]) -> (file, lineno, section, line, tokens,
    n_tokens, numbers, n_numbers, terminated) for content lines.

    ``order_cols`` put a file's lines in order; ``order`` may give one number that does so, by
    which a long file is cut anywhere. ``header`` gives a line's header name (NULL when it is not
    a header); by default :func:`keyword_header`.
    """
    hdr = header if header is not None else keyword_header(F.col("line"))
    tagged = lines.withColumn("__hdr", hdr)
    by = list(order_cols)
    if order is not None:
        tagged, by = tagged.withColumn("__order", order), ["__order"]
    return _content(ordered_scan(tagged, ["file"], by, carried={"section": "__hdr"}, rows_per_chunk=rows_per_chunk), order_cols)


def numbered_lines(raw: DataFrame, header: Column | None = None, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Lines of split files -> (file, lineno, line, section, section_no, __hdr[, sums...]).

    ``raw`` has (file, block, place, line): the split a line was read from and its
    place, rising inside the split. A split is one chunk of its file: the counts and
    last headers of a file's splits, a row each, are prefix-summed, so a file of any
    size is numbered from 0 and its sections carried over split borders by tasks
    that see one split each. ``sums`` names running sums (inclusive) of whole numbers
    taken from ``line`` and ``__hdr``.
    """
    hdr = header if header is not None else keyword_header(F.col("line"))
    sums = dict(sums or {})
    rows = raw.withColumn("__hdr", hdr).withColumns({f"__v_{k}": c.cast("long") for k, c in sums.items()})
    blocks = rows.groupBy("file", "block").agg(
        *[F.sum(f"__v_{k}").alias(f"t_{k}") for k in sums],
        F.count(F.lit(1)).alias("n"), F.count("__hdr").alias("h"), F.max_by("__hdr", F.when(F.col("__hdr").isNotNull(), F.col("place"))).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__lines"),
                           F.coalesce(F.sum("h").over(before), F.lit(0)).alias("__headers"),
                           *[F.coalesce(F.sum(f"t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums],
                           F.last("last", ignorenulls=True).over(before).alias("__from"))
    w = Window.partitionBy("file", "block").orderBy("place")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select("file", "block", "line", "__hdr", (F.row_number().over(w) - 1).alias("__at"),
                         *[F.sum(f"__v_{k}").over(run).alias(f"__r_{k}") for k in sums],
                         F.last("__hdr", ignorenulls=True).over(run).alias("__own"), F.count("__hdr").over(run).alias("__n"))
    return placed.join(blocks, ["file", "block"]).select(
        "file", (F.col("__lines") + F.col("__at")).cast("long").alias("lineno"), "line", F.coalesce("__own", "__from").alias("section"),
        (F.col("__headers") + F.col("__n")).cast("long").alias("section_no"), "__hdr",
        *[(F.col(f"__b_{k}") + F.col(f"__r_{k}")).alias(k) for k in sums])


def scan_keyword_files(raw: DataFrame, header: Column | None = None) -> DataFrame:
    """Content lines of split keyword files (see :func:`numbered_lines`), as :func:`section_scan` gives them."""
    return _content(numbered_lines(raw, header), ("lineno",))


def tail_lines(text_col: str, n: int = 300) -> Column:
    """The last ``n`` lines of a text (all of it when shorter): the part after
    the n-th line break counted from the end, found without splitting."""
    return F.substring_index(normalized_lines(F.col(text_col)), "\n", -n)


def line_count(text_col: str) -> Column:
    body = normalized_lines(F.col(text_col))
    breaks = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    return F.when(F.col(text_col) == "", F.lit(0)).otherwise(breaks + 1)


def failure_log(stdout_col: str, stderr_col: str, n: int = 300) -> Column:
    """The persisted log of a failed run: the last ``n`` lines of stdout and of
    stderr under their headers."""
    # The headings of the log format.
    return F.concat(F.lit("=== STDOUT (tail) ===\n"), tail_lines(stdout_col, n),
                    F.lit("\n\n=== STDERR (tail) ===\n"), tail_lines(stderr_col, n), F.lit("\n"))


def failure_logs(outcomes: DataFrame, n: int = 300) -> DataFrame:
    """(reservoir_id, sim_id, log) for runs that did not succeed, from
    (reservoir_id, sim_id, ok, stdout, stderr); NULL streams count as empty."""
    o = outcomes.where(~F.col("ok")).select(
        "reservoir_id", "sim_id", F.coalesce(F.col("stdout"), F.lit("")).alias("__out"),
        F.coalesce(F.col("stderr"), F.lit("")).alias("__err"))
    return o.select("reservoir_id", "sim_id", failure_log("__out", "__err", n).alias("log"))
