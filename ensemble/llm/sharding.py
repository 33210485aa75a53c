"""Sharding by balanced label propagation (operator 13), in DataFrame expressions only.

Documents that share a link value (equal texts by default) are linked; a link
value is a hub, so a group of any size is a star and its pairs are never listed.
Rows with the same hubs are interchangeable for the cut. They are counted into
cells of a bounded number of rows, (hubs, salt), whose salts come from the row
itself: a group that holds a third of all rows is many small cells, spread over
all tasks, and cells are what the rounds move.

Each round joins the cells with the weights of their hubs by shard. A cell
wants the shard where most of its neighbours' rows are, among those that still
have room; a group larger than a quota wants as many shards as it needs. For each pair of shards the wanted moves are counted by priority
(neighbours there, then a hash), and those of highest priority move, as far as the
target's quota of linked rows allows. Only loads and counts by pair of shards
and priority, whose number is fixed, reach the driver. Rounds end when nothing
moves, or after ``rounds``.

The law is ``rows``: in the end each shard holds floor(N / shards) rows or one
more. Shards over their quota give rows to those under it, unlinked documents
first (at no cut), then the smallest groups, each as a whole, by prefix sums of the
cells in that order; only what lies on a border of two shards' shares is split.

Defined cases: a null text has size 1, crc32 0 and is linked with nothing, and so
is an empty text (neither has content to keep together); null doc_ids are rows
like others; repeated rows are linked with each other and get a slot each; fewer
documents than shards leave shards empty; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, written, written_at

SHARDS, ROUNDS = 8, 8
#: Rows a cell of a hot hub holds at most, about; buckets of the orders of cells and rows.
CELL_ROWS, BUCKETS = 50_000, 4096
#: Powers of two by which neighbours' numbers are told apart; that from which groups move in pieces, and their number.
SIZES, WHOLE, PIECES = 40, 6, 64
#: Share of its quota by which a shard's linked rows may exceed it between rounds; whole groups leave in the end.
SLACK = 16


def link_of_text() -> Column:
    """The default link: the text, where there is one."""
    return F.when(F.length("text") > 0, F.col("text"))


def _hub(link: Column) -> Column:
    """128 bits of a link value's hash; no bytes for none."""
    return F.coalesce(F.unhex(F.md5(link.cast("string").cast("binary"))), F.lit(b""))


def _shares(weights: str, n: int) -> Column:
    """Array with the weight of each shard from (shard, n) pairs of one row."""
    return F.array(*[F.coalesce(F.sum(F.when(F.col("shard") == s, F.col(weights))), F.lit(0)).cast("long") for s in range(n)])


def _loads(cells: DataFrame, shards: int, where: str = "true") -> list[int]:
    got = {r.shard: r.n for r in cells.filter(where).groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def accepted(wanted: dict[tuple[int, int, int], int], load: list[int], quota: list[int]) -> tuple[dict[tuple[int, int], int], set[int]]:
    """For each (from, to), the step of priority (0 first) up to which moves are made; and the shards that turned rows away.

    ``wanted`` counts rows by (from, to, step). All moves are taken first; a shard
    that would end above its quota turns away what has the lowest priority, which
    then stays where it is, until no shard that takes rows ends above its quota.
    """
    coming: dict[int, list[tuple[int, int, int]]] = {}
    end = list(load)
    for (a, b, step), n in wanted.items():
        coming.setdefault(b, []).append((step, a, n))
        end[a] -= n
        end[b] += n
    for moves in coming.values():
        moves.sort()
    turned = set()
    while over := [b for b, moves in coming.items() if moves and end[b] > quota[b]]:
        for b in over:
            turned.add(b)
            while coming[b] and end[b] > quota[b]:
                _, a, n = coming[b].pop()
                end[b] -= n
                end[a] += n
    upto: dict[tuple[int, int], int] = {}
    for b, moves in coming.items():
        for step, a, _ in moves:
            upto[a, b] = step
    return upto, turned


def propagate(cells: DataFrame, hubs: Sequence[str], shards: int, quota: list[int], rounds: int) -> DataFrame:
    """Cells (hubs..., salt, n, linked, size, shard) after the rounds; only linked ones move."""
    key = [*hubs, "salt"]
    numbers = F.array(*[F.lit(s) for s in range(shards)])
    turned: set[int] = set()
    for _ in range(rounds):
        load = _loads(cells, shards, "linked")
        # a shard that has just turned rows away is left out for a round
        open_to = F.array(*[F.lit(s not in turned) for s in range(shards)])
        ends = cells.filter("linked").select(*key, "n", "shard", F.explode(F.array(*[
            F.struct(F.lit(i).alias("kind"), F.col(h).alias("hub")) for i, h in enumerate(hubs)])).alias("k")) \
            .select(*key, "n", "shard", "k.kind", "k.hub").filter("octet_length(hub) > 0")
        weights = ends.groupBy("kind", "hub").agg(_shares("n", shards).alias("w"))
        near = ends.join(weights, ["kind", "hub"])
        if len(hubs) > 1:
            total = F.array(*[F.sum(F.col("w")[s]) for s in range(shards)])
            near = near.groupBy(*key, "n", "shard").agg(total.alias("w"), F.min("hub").alias("hub"))
        # the heaviest open shard (or the own one); ties by a hash of the hub, so that they do not meet in one shard
        score = F.transform(numbers, lambda s: F.struct(
            F.when((s == F.col("shard")) | F.element_at(open_to, s + 1), F.element_at("w", s + 1)).otherwise(F.lit(-1)).alias("weight"),
            F.pmod(F.xxhash64("hub", s), F.lit(1 << 20)).alias("tie"), s.alias("to")))
        # a group of more rows than a quota takes as many shards as it needs, its cells dealt over them
        needs = F.greatest(F.ceil(F.aggregate("w", F.lit(0).cast("long"), lambda x, y: x + y) / F.lit(max(1, min(quota)))), F.lit(1)).cast("int")
        near = near.withColumn("top", F.slice(F.sort_array(score, asc=False), F.lit(1), F.least(needs, F.lit(shards))))
        own = F.get(F.filter("top", lambda t: t["to"] == F.col("shard")), 0)
        dealt = F.get("top", F.pmod(F.xxhash64(*key), F.size("top")).cast("int"))
        moves = near.withColumn("best", F.coalesce(own, dealt)).select(*key, "n", "hub", F.col("shard").alias("from"), "best.to", "best.weight") \
            .filter(F.col("from") != F.col("to"))
        # many neighbours first; groups of a size move whole, by a hash of the hub, the largest piece by piece
        magnitude = F.least(F.floor(F.log2(F.col("weight") + F.lit(1.0))), F.lit(SIZES - 1))
        part = F.when(magnitude >= WHOLE, F.pmod(F.xxhash64(*key), F.lit(PIECES))).otherwise(0)
        step = ((F.lit(SIZES - 1) - magnitude) * 16 + F.pmod(F.xxhash64("hub"), F.lit(16))) * PIECES + part
        moves = saved(moves.withColumn("step", step.cast("int")).drop("hub", "weight"))
        wanted = {(r["from"], r["to"], r.step): r.n for r in moves.groupBy("from", "to", "step").agg(F.sum("n").alias("n")).collect()}
        upto, turned = accepted(wanted, load, [q + q // SLACK for q in quota])
        if not upto:
            break
        allowed = F.lit(-1)
        for (a, b), s in upto.items():
            allowed = F.when((F.col("from") == a) & (F.col("to") == b), s).otherwise(allowed)
        chosen = moves.filter(F.col("step") <= allowed).select(*key, "to")
        cells = saved(cells.join(chosen, key, "left").withColumn("shard", F.coalesce("to", "shard")).select(*key, "n", "linked", "size", "shard"))
    return cells


def _prefixed(df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Adds ``start``: the rows (n) of the cells before, in (bucket, order) order within the group; no task gets more than a bucket."""
    rows = df.withColumn("bucket", bucket)
    totals = rows.groupBy(*group, "bucket").agg(F.sum("n").alias("in_bucket"))
    w = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a fixed number of buckets
    totals = totals.select(*group, "bucket", F.coalesce(F.sum("in_bucket").over(w), F.lit(0)).alias("offset"))
    inner = Window.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(totals), [*group, "bucket"]) \
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("n").over(inner), F.lit(0))).drop("bucket", "offset")


def rebalanced(cells: DataFrame, key: Sequence[str], shards: int, quota: list[int]) -> DataFrame:
    """(key..., begin, end, shard): ranges of each cell's rows, so that every shard holds its quota exactly."""
    load = _loads(cells, shards)
    excess = [max(0, x - q) for x, q in zip(load, quota)]
    # rows that leave, in one line over all shards, are dealt to the shards with room in order
    given, cuts, at = [0], [], 0
    for e in excess:
        given.append(given[-1] + e)
    for s in range(shards):
        if load[s] < quota[s]:
            cuts.append((at, at + quota[s] - load[s], s))
            at += quota[s] - load[s]
    cell = F.xxhash64(*key)
    # unlinked cells leave first, then those of small groups, the cells of a group after one another
    group = F.when(F.col("linked"), F.xxhash64(key[0])).otherwise(cell)
    size = F.least(F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double"))), F.lit(SIZES - 1))
    rank = F.when(F.col("linked"), F.lit(BUCKETS) + size * 256 + F.pmod(group, F.lit(256))).otherwise(F.pmod(group, F.lit(BUCKETS)))
    placed = _prefixed(cells.filter(F.col("shard").isin([s for s in range(shards) if excess[s]])), ["shard"], [group, *key], rank)
    over, line = F.lit(0), F.lit(0)
    for s in range(shards):
        over = F.when(F.col("shard") == s, F.lit(excess[s])).otherwise(over)
        line = F.when(F.col("shard") == s, F.lit(given[s])).otherwise(line)
    leaving = F.least(F.greatest(over - F.col("start"), F.lit(0)), F.col("n"))  # the cell's first rows leave
    placed = placed.withColumn("leaves", leaving.cast("long")).withColumn("at", (line + F.col("start")).cast("long"))
    pieces = [F.struct(F.col("leaves").alias("begin"), F.col("n").alias("end"), F.col("shard").alias("shard"))]
    for lo, hi, s in cuts:
        begin = F.greatest(F.lit(lo) - F.col("at"), F.lit(0))
        end = F.least(F.lit(hi) - F.col("at"), F.col("leaves"))
        pieces.append(F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"), F.lit(s).alias("shard")))
    split = placed.select(*key, F.explode(F.filter(F.array(*pieces), lambda p: p["end"] > p["begin"])).alias("p")).select(*key, "p.*")
    whole = cells.filter(~F.col("shard").isin([s for s in range(shards) if excess[s]])).select(
        *key, F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"), "shard")
    return split.union(whole)


def shard_documents(docs: DataFrame, shards: int = SHARDS, links: Sequence[Column] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text).

    ``links``: expressions over ``docs``; rows whose values of one are equal, as text,
    are linked (null: not by this one).
    """
    spark = docs.sparkSession
    body = F.coalesce("text", F.lit(""))
    links = [link_of_text()] if links is None else list(links)
    hubs = [f"hub{i}" for i in range(len(links))]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), *[_hub(x).alias(h) for x, h in zip(links, hubs)])
    path = written_at(spark, "sharding")
    base = written(base, "sharding", path)
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    salts = max(64, -(-total // CELL_ROWS)) * shards
    # rows without links are spread by what they hold; equal rows may fall in one cell
    salt = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(salts)).cast("int")
    base = base.withColumn("salt", salt)
    key = [*hubs, "salt"]
    cells = base.groupBy(*key).agg(F.count("*").alias("n"))
    linked = None
    for h in hubs:
        sums = cells.filter(F.octet_length(h) > 0).groupBy(h).agg(F.sum("n").alias(f"of_{h}"))
        cells = cells.join(sums, h, "left")
        linked = F.coalesce(f"of_{h}", F.lit(0)) if linked is None else F.greatest(linked, F.coalesce(f"of_{h}", F.lit(0)))
    cells = saved(cells.withColumn("size", linked).withColumn("linked", F.col("size") > 1)
                  .withColumn("shard", (F.col("salt") % shards).cast("int")).select(*key, "n", "linked", "size", "shard"))
    cells = propagate(cells, hubs, shards, quota, rounds)
    pieces = saved(rebalanced(cells, key, shards, quota))

    # rows of a cell are numbered in it; a piece takes a range of the numbers
    many = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "size", "text_crc32")) - 1
    rows, parts = base.withColumn("no", many).alias("r"), pieces.alias("p")
    same = F.expr(" and ".join(f"r.{k} = p.{k}" for k in key))
    sharded = rows.join(parts, same & F.expr("r.no >= p.begin and r.no < p.end")).select(
        "r.doc_id", "r.size", "r.text_crc32", "p.shard", F.lit(1).alias("n"))
    sharded = saved(sharded)
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(BUCKETS))
    out = _prefixed(sharded, ["shard"], ["doc_id", "text_crc32", "size"], bucket)
    discard(spark, path)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("start").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
