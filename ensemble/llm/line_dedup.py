"""Near-duplicate lines by an exact set-similarity join (operator 8).

A line's tokens are its distinct five-word shingles (a line of fewer words has
its word sequence as its one token). Tokens are ordered from rare to frequent,
by counts over all lines. Lines with Jaccard similarity of at least num/den
share one of their first n - ceil(n * num/den) + 1 tokens (prefix filter), so
only lines that share such a token are compared, if their lengths and the places
of the shared token allow the similarity (length and positional filters) and
the sketches of their tokens do not rule it out. Remaining pairs are verified on
the token sets. A line is removed if an earlier line (by doc_id, then line
number) is similar to it, whether or not that one is removed itself; so the
result depends on no processing order.

The frequency order comes from a table of 2**BUCKET_BITS counters over hashed
tokens, whose size is fixed; any total order gives the same result, a good one
makes fewer candidates.

Defined cases: lines end at line feeds; lines without words are never removed;
null or empty texts have no lines; rows with the same doc_id and text are one
document (both lose the same lines), rows with the same doc_id and another text
come after one another by a hash of the text; a null doc_id comes first; an
empty table gives no rows; other columns are passed through by ``dedup_lines``
and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import bit_table, blocks, discard, map_arrow, may_hold, release, saved, small, written, written_at
from .similar import CHUNK_BYTES, aligned, check_pairs, parity, runs, sketch_bits

SHINGLE = 5
BUCKET_BITS = 18
#: Token counters that are added up in one row.
COUNTER_SLICE = 1 << 15
_U = np.uint64
_WEIGHT = np.cumprod(np.full(SHINGLE, 0xD6E8FEB86659FD93, _U), dtype=_U)
#: Lines that share a token are paired directly up to this number, beyond it by sketches.
SMALL_GROUP = 16
#: Bytes of prefixes whose tokens are dealt together, and of dealt tokens that are compared together (about).
DEAL_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20


def line_tokens(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row of each line, its number, line of each token, tokens) of runs of texts; tokens may repeat."""
    body, off = W.byte_view(col)
    n, row = len(off) - 1, 0
    while row < n:
        end = max(row + 1, min(n, int(np.searchsorted(off, off[row] + W.SEGMENT, side="right")) - 1))
        size = np.diff(off[row : end + 1])
        buf = np.full(int(size.sum()) + len(size), 10, np.uint8)  # a line feed ends each text
        at = np.cumsum(size + 1) - (size + 1)
        keep = np.ones(len(buf), dtype=bool)
        keep[at + size] = False
        buf[keep] = body[off[row] : off[end]]
        feeds = np.flatnonzero(buf == 10)
        doc_of = np.searchsorted(at, feeds, side="right") - 1
        first = np.searchsorted(doc_of, np.arange(len(size)))
        number = np.arange(len(feeds)) - first[doc_of]
        h, start, _ = W.spans(buf)
        line = np.cumsum(buf == 10, dtype=np.int32)[start].astype(np.int64)
        count = np.bincount(line, minlength=len(feeds))
        begin = np.cumsum(count) - count
        tokens, owner = [], []
        if len(h) >= SHINGLE:
            inner = np.flatnonzero(line[: len(h) - SHINGLE + 1] == line[SHINGLE - 1 :])
            acc = np.full(len(h) - SHINGLE + 1, SHINGLE, _U)
            for i in range(SHINGLE):
                acc += h[i : len(acc) + i] * _WEIGHT[i]
            tokens.append(W.mix(acc[inner]))
            owner.append(line[inner])
        for k in range(1, SHINGLE):
            short = np.flatnonzero(count == k)
            acc = np.full(len(short), k, _U)
            for i in range(k):
                acc += h[begin[short] + i] * _WEIGHT[i]
            tokens.append(W.mix(acc))
            owner.append(short)
        yield row, doc_of, number, np.concatenate(owner), np.concatenate(tokens)
        row = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for b in batches:
        for *_, tokens in line_tokens(b.column("text")):
            total += np.bincount((tokens & _U((1 << BUCKET_BITS) - 1)).astype(np.int64), minlength=1 << BUCKET_BITS)
    yield pa.RecordBatch.from_pydict({"slice": np.arange(len(total) // COUNTER_SLICE, dtype=np.int32),
                                      "n": [x.tobytes() for x in total.reshape(-1, COUNTER_SLICE)]})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice of the counters that a task meets."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, n in zip(b.column("slice").to_pylist(), b.column("n").to_pylist()):
            sums[i] = sums.get(i, 0) + np.frombuffer(n, np.int64)
    yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "n": pa.array([x.tobytes() for x in sums.values()], pa.binary())})


def rarity(texts: DataFrame) -> np.ndarray:
    """Rank of each bucket of hashed tokens, the rarest first."""
    slices = map_arrow(texts.select("text"), _count, "slice int, n binary")
    rows = map_arrow(slices.repartition((1 << BUCKET_BITS) // COUNTER_SLICE, "slice"), _add, "slice int, n binary").toArrow()
    n = np.zeros((1 << BUCKET_BITS) // COUNTER_SLICE * COUNTER_SLICE, np.int64)
    for i, x in zip(rows.column("slice").to_pylist(), rows.column("n").to_pylist()):
        n[i * COUNTER_SLICE : (i + 1) * COUNTER_SLICE] = np.frombuffer(x, np.int64)
    rank = np.empty(1 << BUCKET_BITS, _U)
    rank[np.argsort(n, kind="stable")] = np.arange(1 << BUCKET_BITS, dtype=_U)
    return rank


def in_order(tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Tokens recoded one to one, so that their numeric order goes from rare to frequent."""
    bucket = (tokens & _U((1 << BUCKET_BITS) - 1)).astype(np.int64)
    return rank[bucket] << _U(64 - BUCKET_BITS) | tokens >> _U(BUCKET_BITS)


def _sets(line: np.ndarray, tokens: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct tokens line by line, offset and size of each line)."""
    by_line = line, tokens
    if n_lines < 1 << 20:  # one key of the line and the token's high bits sorts faster
        order = np.argsort(line.astype(_U) << _U(44) | tokens >> _U(20))
        line, tokens = line[order], tokens[order]
    if n_lines >= 1 << 20 or ((line[1:] == line[:-1]) & (tokens[1:] < tokens[:-1])).any():
        line, tokens = by_line
        order = np.lexsort((tokens, line))
        line, tokens = line[order], tokens[order]
    new = np.ones(len(line), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (tokens[1:] != tokens[:-1])
    line, tokens = line[new], tokens[new]
    size = np.bincount(line, minlength=n_lines)
    return tokens, np.cumsum(size) - size, size


def _ids(tokens: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit id of each line's token set (0 for lines without words)."""
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(W.mix(tokens), dtype=_U)])
    return np.where(size > 0, W.mix(sums[start + size] - sums[start] + size.astype(_U)), 0).view(np.int64)


def _lines(rank, num: int, den: int):
    """One row for each line with words: its place, its set's id and size, and its prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        for b in batches:
            doc, key = b.column("doc_id"), b.column("key")
            for row, doc_of, number, line, tokens in line_tokens(b.column("text")):
                tokens, start, size = _sets(line, in_order(tokens, order), len(number))
                ids = _ids(tokens, start, size)
                some = np.flatnonzero(size)
                # of copies among these texts one has the prefix, the others an empty one
                prefix = np.zeros(len(some), np.int64)
                first = np.unique(ids[some], return_index=True)[1]
                prefix[first] = (size - -(-size * num // den) + 1)[some[first]]
                body = tokens[np.arange(int(prefix.sum())) + np.repeat(start[some] - (np.cumsum(prefix) - prefix), prefix)]
                ends = np.concatenate([[0], np.cumsum(prefix * 8)]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(body)])
                at = pa.array(doc_of[some] + row)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": doc.take(at), "key": key.take(at), "line": pa.array(number[some], pa.int32()),
                    "id": pa.array(ids[some]), "size": pa.array(size[some], pa.int32()), "prefix": data})
    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, n = b.column("prefix"), pc.binary_length(b.column("prefix")).to_numpy() // 8
        body, _ = W.byte_view(data)
        rows = np.repeat(np.arange(b.num_rows), n)
        pos = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_pydict({"tok": np.frombuffer(body.tobytes(), np.int64), "id": b.column("id").to_numpy()[rows],
                                          "place": b.column("size").to_numpy().astype(np.int64)[rows] << 32 | pos})


def _dealt(buckets: int):
    """Prefix tokens, each with the smallest and the largest id of the sets that have it, packed by bucket.

    However many lines hold a token, a run of prefixes gives out two entries of it at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, DEAL_BYTES, lambda b: b.nbytes):
            data = t.column("prefix").combine_chunks()
            tok = np.frombuffer(W.byte_view(data)[0].tobytes(), _U)
            ids = np.repeat(t.column("id").to_numpy(), pc.binary_length(data).to_numpy() // 8)
            tok, least, most = _ends(tok, ids)
            several = least != most
            tok, ids = np.concatenate([tok, tok[several]]), np.concatenate([least, most[several]])
            bucket = (tok % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, entries = bucket[order], np.column_stack([tok.view(np.int64), ids])[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            yield pa.RecordBatch.from_pydict({"bucket": bucket[cuts[:-1]], "data": [entries[a:z].tobytes() for a, z in zip(cuts, cuts[1:])]})
    return run


def _ends(tok: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, smallest and largest id of each)."""
    order = np.argsort(tok)
    tok, ids = tok[order], ids[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(tok)), dtype=bool), tok[1:] != tok[:-1]]))
    if not len(start):
        return tok, ids, ids
    return tok[start], np.minimum.reduceat(ids, start), np.maximum.reduceat(ids, start)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a bucket that different sets have."""
    for t in runs(batches, ["bucket"]):
        entries = np.frombuffer(b"".join(t.column("data").to_pylist()), np.int64).reshape(-1, 2)
        tok, least, most = _ends(entries[:, 0], entries[:, 1])
        yield pa.RecordBatch.from_pydict({"tok": tok[least != most]})


def _shared_prefixes(shared):
    """Prefix tokens that the bit table of shared tokens may hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _prefixes(batches):
            yield b.filter(pa.array(may_hold(shared.value, b.column("tok").to_numpy().view(_U))))
    return run


def _wanted_sets(shared):
    """Token sets (id, doc_id, key, line, toks) of the lines whose id may be asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, asked = shared.value
        for b in batches:
            doc, key = b.column("doc_id"), b.column("key")
            for row, doc_of, number, line, tokens in line_tokens(b.column("text")):
                tokens, start, size = _sets(line, in_order(tokens, order), len(number))
                ids = _ids(tokens, start, size)
                some = np.flatnonzero((size > 0) & may_hold(asked, ids.view(_U)))
                at = pa.array(doc_of[some] + row)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids[some]), "doc_id": doc.take(at), "key": key.take(at), "line": pa.array(number[some], pa.int32()),
                    "toks": pa.array([tokens[start[i] : start[i] + size[i]].tobytes() for i in some.tolist()], pa.binary())})
    return run


def _sketch(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x.as_buffer(), _U) for x in b.column("toks")]
            # the low bits of recoded tokens are those of their hashes
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "sketch": pa.array(
                [parity(s, sketch_bits(len(s), num, den)) for s in sets], pa.binary())})
    return run


def _candidates(most: int, num: int, den: int):
    """For each open line of a group, the ``most`` nearest earlier lines that no filter rules out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["tok", "lo", "hi"]):
            probe = np.flatnonzero(t.column("probe").to_numpy(zero_copy_only=False))
            base = np.flatnonzero(t.column("base").to_numpy(zero_copy_only=False))
            if not len(probe) or not len(base):
                continue
            ids, n = t.column("id").to_numpy(), t.column("size").to_numpy().astype(np.int64)
            order = np.empty(t.num_rows, np.int64)
            order[np.lexsort([t.column(c).to_numpy() for c in ("line", "key", "doc")])] = np.arange(t.num_rows)
            refused, sketch = t.column("refused").to_pylist(), aligned(t.column("sketch"))
            out = []
            for i in probe:
                js = base[(order[base] < order[i]) & (ids[base] != ids[i])]
                js = js[(den * n[js] >= num * n[i]) & (den * n[i] >= num * n[js])]  # length
                if refused[i] and len(js):
                    js = js[~np.isin(ids[js], refused[i])]
                if not len(js):
                    continue
                total = n[js] + n[i]
                dist = np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1).astype(np.int64)
                room = total - 2 * -(-num * total // (num + den)) - dist
                js, room = js[room >= 0], room[room >= 0]
                best = np.argsort(-room, kind="stable")[:most]
                out.append(np.column_stack([np.full(len(best), ids[i]), ids[js[best]], room[best]]))
            if out:
                x = np.concatenate(out)
                yield pa.RecordBatch.from_pydict({"later": x[:, 0], "earlier": x[:, 1], "room": x[:, 2]})
    return run


def _paired(rows: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """(later, earlier) of the lines that share tokens of small groups and that their prefixes allow.

    Of two similar lines' tokens, all common ones up to the end of the prefix
    that ends first are common prefix tokens; so the overlap is at most their
    number and what the other tokens of that line can add. Shared tokens of
    large groups (``wide``: how many a line has there) are not counted here, and
    so allowed for.
    """
    size = lambda c: F.shiftright(F.col(c), 32)
    pos = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    x, y = (rows.select("tok", *[F.col(c).alias(f"{c}_{v}") for c in ("id", "place", "first")]) for v in ("x", "y"))
    pairs = x.join(y, "tok").filter("first_x > first_y") \
        .filter((den * size("place_y") >= num * size("place_x")) & (den * size("place_x") >= num * size("place_y"))) \
        .groupBy(F.col("id_x").alias("later"), F.col("id_y").alias("earlier")).agg(
            F.count("*").alias("shared"), F.max(size("place_x")).alias("nx"), F.max(size("place_y")).alias("ny"),
            F.min(pos("place_x")).alias("px"), F.min(pos("place_y")).alias("py"))
    for side, name in (("later", "wx"), ("earlier", "wy")):
        pairs = pairs.join(wide.select(F.col("id").alias(side), F.col("wide").alias(name)), side, "left")
    more = F.least(F.coalesce("wx", F.lit(0)), F.coalesce("wy", F.lit(0)))
    least = F.ceil(F.lit(num) * (F.col("nx") + F.col("ny")) / (num + den))
    rest = F.ceil(F.greatest("nx", "ny") * F.lit(num) / den) - 1
    # the first shared token's place bounds the overlap too, if no token of a large group may come before it
    return pairs.filter(F.col("shared") + more + rest >= least) \
        .filter((more > 0) | (F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= least)).select("later", "earlier")


def line_table(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, key (hash of the text), line, removed of every line with words."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")) \
        .withColumn("key", F.xxhash64("text"))
    rank = spark.sparkContext.broadcast(rarity(texts))
    path = written_at(spark, "lines")  # an intermediate table, removed at the end
    lines = written(map_arrow(texts, _lines(rank, num, den), "doc_id long, key long, line int, id long, size int, prefix binary"), "lines", path)
    firsts = saved(lines.groupBy("id").agg(F.min(F.struct("doc_id", "key", "line")).alias("first"), F.count("*").alias("n")))

    # tokens that different sets have: found from two ids of each token a run, so that no token's lines meet in one task
    prefixes = lines.filter("octet_length(prefix) > 0")
    size = prefixes.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0]
    buckets = max(4 * n, -(-2 * size // BUCKET_BYTES))
    dealt = map_arrow(prefixes.select("id", "prefix"), _dealt(buckets), "bucket int, data binary")
    toks = saved(map_arrow(dealt.repartition(n, "bucket").sortWithinPartitions("bucket"), _shared, "tok long"))
    rows = map_arrow(prefixes.select("id", "size", "prefix"), _shared_prefixes(spark.sparkContext.broadcast(bit_table(toks, "tok"))),
                     "tok long, id long, place long")
    shared = saved(rows.distinct().join(small(toks), "tok", "left_semi"))
    release(spark)

    # the candidate lines' places, and their sets (each read once, from its first occurrence)
    involved = saved(shared.select("id").distinct().join(firsts.select("id", "first"), "id"))
    asked = involved.select("first.doc_id", "first.key").distinct()
    where = texts.alias("t").join(small(asked).alias("r"), F.expr("t.doc_id <=> r.doc_id and t.key = r.key"), "left_semi")
    read = map_arrow(where, _wanted_sets(spark.sparkContext.broadcast((rank.value, bit_table(involved, "id")))),
                     "id long, doc_id long, key long, line int, toks binary")
    same = F.expr("s.id = i.id and s.doc_id <=> i.first.doc_id and s.key = i.first.key and s.line = i.first.line")
    sets = saved(read.alias("s").join(small(involved, 500_000).alias("i"), same, "left_semi").select("id", "toks"))
    release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        """later, earlier, ok."""
        return check_pairs(saved(pairs), lambda ids: sets, num, den, ("later", "earlier"))

    place = F.struct(F.coalesce("first.doc_id", F.lit(-(1 << 63))).alias("doc"), F.col("first.key").alias("key"), F.col("first.line").alias("line"))
    shape = shared.groupBy("tok").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"),
                                      F.bit_xor(F.xxhash64("id")).alias("x"))
    few = shared.join(shape.filter(F.col("n") <= SMALL_GROUP).select("tok"), "tok").join(involved, "id").select("tok", "id", "place", place.alias("first"))
    many = saved(shape.filter(F.col("n") > SMALL_GROUP))
    wide = shared.join(many.select("tok"), "tok").groupBy("id").agg(F.count("*").alias("wide"))
    checked = verified(_paired(few, wide, num, den))
    matched, failed = checked.filter("ok").select("later", "earlier"), checked.filter("not ok").select("later", "earlier")

    # large groups with the same lines are one group; each line probes every chunk, and is a base line in its own
    groups = many.groupBy("n", "a", "b", "x").agg(F.min("tok").alias("tok")).select(
        "tok", F.ceil(F.col("n") * 256 / CHUNK_BYTES).cast("int").alias("chunks"))
    groups = saved(shared.join(groups, "tok").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
                   .select("tok", "id", F.shiftright("place", 32).alias("size"), "own",
                           F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")))
    if not groups.isEmpty():
        sketches = saved(map_arrow(sets.join(groups.select("id").distinct(), "id", "left_semi"), _sketch(num, den), "id long, sketch binary")
                         .join(involved, "id").withColumn("first", place).select("id", "sketch", "first.doc", "first.key", "first.line"))
    most = 1  # proposals for each line: the nearest one, then more of what is left
    still = None  # lines whose proposals all failed so far; one without a proposal has no candidate left
    while not groups.isEmpty():
        refused = failed.groupBy(F.col("later").alias("id")).agg(F.collect_set("earlier").alias("refused"))
        if still is None:
            done = matched.select(F.col("later").alias("id")).distinct().withColumn("open", F.lit(False))
        else:
            done = small(still).withColumn("open", F.lit(True))
            groups = saved(groups.join(small(groups.join(small(still), "id", "left_semi").select("tok").distinct()), "tok", "left_semi"))
        roles = F.when(F.col("own") == F.col("other"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
        members = groups.join(refused, "id", "left").join(done, "id", "left").select("*", F.explode(roles).alias("role")) \
            .select("tok", "id", "size", "refused",
                    F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")).alias("lo"),
                    F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own")).alias("hi"),
                    ((F.col("role") == 0) & F.coalesce("open", F.lit(still is None))).alias("probe"),
                    ((F.col("role") == 1) | (F.col("own") == F.col("other"))).alias("base"))
        part = members.join(sketches, "id").repartition(n, "tok", "lo", "hi").sortWithinPartitions("tok", "lo", "hi")
        proposed = map_arrow(part, _candidates(most, num, den), "later long, earlier long, room long")
        proposed = saved(proposed.groupBy("later").agg(F.max_by("earlier", F.struct("room", "earlier")).alias("earlier"))
                         .select("later", "earlier") if most == 1 else proposed.select("later", "earlier").distinct())
        most *= 8
        if proposed.isEmpty():
            break
        checked = verified(proposed)
        matched = saved(matched.union(checked.filter("ok").select("later", "earlier")))
        failed = saved(failed.union(checked.filter("not ok").select("later", "earlier")))
        still = saved(checked.select(F.col("later").alias("id")).distinct().join(matched.select(F.col("later").alias("id")), "id", "left_anti"))
        release(spark)
    # only a set that several lines have, or with an earlier similar one, can have lines to remove
    near = matched.select(F.col("later").alias("id"), F.lit(True).alias("near")).distinct()
    again = firsts.filter("n > 1").select("id", "first")
    out = saved(lines.select("doc_id", "key", "line", "id").join(small(again, 500_000), "id", "left").join(small(near), "id", "left")
                .select("doc_id", "key", "line", (F.col("near").isNotNull() | (F.col("first").isNotNull()
                        & ~F.col("first").eqNullSafe(F.struct("doc_id", "key", "line")))).alias("removed"))
                .repartition("doc_id", "key").distinct())
    discard(spark, path)
    return out


def removed_lines(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_lines (with words), n_removed, removed (numbers from 0, joined by commas) of each document."""
    table = line_table(docs, num, den).groupBy("doc_id", "key").agg(
        F.count("*").alias("n_lines"), F.count_if("removed").alias("n_removed"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line")))), ",").alias("removed"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    return own.alias("d").join(table.alias("t"), F.expr("d.doc_id <=> t.doc_id and d.key = t.key"), "left").select(
        "d.doc_id", F.coalesce("t.n_lines", F.lit(0)).alias("n_lines"), F.coalesce("t.n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("t.removed", F.lit("")).alias("removed"))


def dedup_lines(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the removed lines, all columns in place (n_chars follows the text, if there is one).

    A document all of whose lines with words are removed has nothing of its own
    left and goes; documents without words stay as they are.
    """
    lost = line_table(docs, num, den).groupBy("doc_id", "key").agg(
        F.count("*").alias("n"), F.collect_list(F.when(F.col("removed"), F.col("line"))).alias("lost")) \
        .filter(F.size("lost") > 0).select("doc_id", "key", (F.size("lost") == F.col("n")).alias("whole"), "lost")
    lost = small(saved(lost), 500_000)
    joined = docs.alias("d").join(lost.alias("l"), F.expr("cast(d.doc_id as long) <=> l.doc_id and xxhash64(coalesce(d.text, '')) = l.key"), "left") \
        .filter(F.coalesce(~F.col("l.whole"), F.lit(True)))
    left = F.array_join(F.filter(F.split("d.text", "\n", -1), lambda x, i: ~F.array_contains("l.lost", i)), "\n")
    text = F.when(F.col("l.lost").isNull(), F.col("d.text")).otherwise(left)
    out = []
    for c in docs.columns:
        own = F.col(f"d.`{c}`")
        if c == "text":
            own = text
        elif c == "n_chars":
            own = F.when(F.col("l.lost").isNull(), own).otherwise(F.length(text)).cast(docs.schema[c].dataType)
        out.append(own.alias(c))
    return joined.select(*out)
