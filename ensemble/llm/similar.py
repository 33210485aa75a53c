"""Exact links inside groups of candidate sets, and connected components.

``groups`` hold sets that share a signature and so may be similar. Pairs are
first held against an exact lower bound of their distance, the differing bits
of parity sketches: a pair that fails it is no link for certain. Of the pairs
that pass and join different components, each set proposes the one that passes
by most; proposals are checked on the sets themselves, and sets propose again,
more of what is left each time, until nothing is left to propose. So all
components are found in a few rounds, and never all pairs of a group are given
out. A group is cut into chunks of
bounded bytes; chunks, and pairs of chunks of a group that still holds different
components, are each one step of a Python stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release, saved, small

#: Bytes of sketches that one chunk of a group holds at most.
CHUNK_BYTES = 4 << 20
#: One of so many groups is looked at before all others.
FIRST = 8


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, from batches sorted by them."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        t = t.combine_chunks()
        cols = [t.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(t.num_rows - 1, dtype=bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1)]
        for a, z in zip(cuts, cuts[1:]):
            yield t.slice(a, z - a)
        held = t.slice(cuts[-1])
    if held is not None:
        yield held


def sketch_bits(size: int, num: int, den: int) -> int:
    """Bits of a set's sketch: many for each element that a similar set may differ in, a byte of bits for each element at most."""
    allowed = 2 * size * (den - num) // (den + num)
    return 1 << max(10, min(22, min(64 * allowed, 8 * size).bit_length()))


def parity(s: np.ndarray, bits: int) -> bytes:
    """Parity of the number of elements in each of ``bits`` (a power of two) cells."""
    cell = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cell.astype(np.uint8)).tobytes()


def aligned(col: pa.ChunkedArray) -> np.ndarray:
    """Sketches as a matrix of words, the longer ones folded to the shortest."""
    rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in col]
    least = min(map(len, rows))
    for i, r in enumerate(rows):
        while len(r) > least:
            r = r[: len(r) // 2] ^ r[len(r) // 2 :]
        rows[i] = r
    return np.stack(rows)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Jaccard similarity at least num / den, in whole numbers."""
    i = overlap(a, b)
    return den * i >= num * (len(a) + len(b) - i)


def proposals(ids: np.ndarray, n: np.ndarray, sketch: np.ndarray, label: np.ndarray, side: np.ndarray | None,
              refused: list, most: int, num: int, den: int) -> np.ndarray:
    """Rows (i, j, room): for each member j, the ``most`` members i before it in another component that
    leave the most room under the bound of the sketches.

    ``side``: propose only pairs of different sides; ``refused``: per member,
    the ids that it is known not to link with.
    """
    out, best = [], np.full(len(ids), -1, np.int64)
    partner = np.zeros(len(ids), np.int64)
    for i in range(len(ids) - 1):
        apart = label[i + 1 :] != label[i]
        if side is not None:
            apart &= side[i + 1 :] != side[i]
        js = np.flatnonzero(apart) + i + 1
        if len(js) and refused[i]:
            js = js[~np.isin(ids[js], refused[i])]
        if not len(js):
            continue
        total = n[js] + n[i]
        least = -(-num * total // (num + den))  # smallest overlap that links
        room = total - 2 * least - np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1).astype(np.int64)
        if most == 1:
            better = room > best[js]
            partner[js[better]], best[js[better]] = i, room[better]
        else:
            ok = room >= 0
            out.append(np.column_stack([np.full(int(ok.sum()), i), js[ok], room[ok]]))
    if most == 1:
        js = np.flatnonzero(best >= 0)
        return np.column_stack([partner[js], js, best[js]])
    rows = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 0], -rows[:, 2], rows[:, 1]))]
    first = np.searchsorted(rows[:, 1], rows[:, 1])
    return rows[np.arange(len(rows)) - first < most]


def _propose(keys: list[str], most: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            ids = t.column("id").to_numpy()
            side = t.column("side").to_numpy() if "side" in t.column_names else None
            p = proposals(ids, t.column("size").to_numpy(), aligned(t.column("sketch")), t.column("label").to_numpy(),
                          side, t.column("refused").to_pylist(), most, num, den)
            if len(p):
                yield pa.RecordBatch.from_pydict({"a": ids[p[:, 0]], "b": ids[p[:, 1]], "room": p[:, 2]})
    return run


def _check(x: str, y: str, num: int, den: int):
    """Rows sorted by pair and id hold the two sets of each pair one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None, None)
        done = None
        for t in batches:
            out: dict[str, list] = {x: [], y: [], "ok": []}
            for a, b, i, toks in zip(*(t.column(c).to_pylist() for c in (x, y, "id", "toks"))):
                if last[0] == (a, b) and last[1] != i and done != (a, b):
                    done = (a, b)
                    out[x].append(a)
                    out[y].append(b)
                    out["ok"].append(similar(np.frombuffer(last[2], np.uint64), np.frombuffer(toks, np.uint64), num, den))
                last = (a, b), i, toks
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(x, pa.int64()), (y, pa.int64()), ("ok", pa.bool_())]))
    return run


def check_pairs(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], num: int, den: int,
                names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """The distinct pairs (columns ``names``) with ok; ``fetch`` gives (id, toks) of at least the ids asked for."""
    x, y = names
    ends = pairs.select(x, y, F.explode(F.array(x, y)).alias("id"))
    n = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = fetch(ends.select("id").distinct()).join(small(ends), "id").select(x, y, "id", "toks") \
        .repartition(n, x, y).sortWithinPartitions(x, y, "id")
    return saved(map_arrow(both, _check(x, y, num, den), f"{x} long, {y} long, ok boolean"))


def links_of_groups(members: DataFrame, sketches: DataFrame, fetch: Callable[[DataFrame], DataFrame],
                    num: int, den: int) -> DataFrame:
    """Links (a, b) that give the same components as all links inside the groups.

    ``members``: gid, id, distinct; ``sketches``: id, size, sketch; ``fetch``: see check_pairs.
    """
    spark = members.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sized = members.join(sketches.select("id", "size", F.octet_length("sketch").alias("bytes")), "id")
    shape = sized.groupBy("gid").agg((F.count("*") * F.max("bytes")).alias("all")) \
        .select("gid", F.ceil(F.col("all") / CHUNK_BYTES).cast("int").alias("chunks"))
    dealt = saved(members.join(shape, "gid").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(17)), F.col("chunks")).cast("int")))
    links = failed = spark.createDataFrame([], "a long, b long")
    # first one of FIRST groups, as near copies share many: most others then hold one component and need no sketches;
    # within chunks, one proposal for each set; then more, and across chunks
    first, across, most = True, False, 1
    while True:
        labelled = dealt.filter(F.pmod(F.xxhash64("gid", F.lit(5)), F.lit(FIRST)) == 0).withColumn("label", F.col("id")) if first else \
            dealt.join(components(links), "id", "left").withColumn("label", F.coalesce("label", "id"))
        still = labelled.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("gid")
        refused = failed.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("refused"))
        part = labelled.join(still, "gid").join(refused, "id", "left")
        keys = ["gid", "chunk"]
        if across:
            part = part.filter("chunks > 1") \
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("other <> chunk") \
                .select("*", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"),
                        (F.col("chunk") < F.col("other")).cast("int").alias("side"))
            keys = ["gid", "lo", "hi"]
        part = part.join(sketches, "id").repartition(n, *keys).sortWithinPartitions(*keys, "id")
        proposed = map_arrow(part, _propose(keys, most, num, den), "a long, b long, room long")
        proposed = saved(proposed.groupBy("b").agg(F.max_by("a", F.struct("room", "a")).alias("a")) if most == 1
                         else proposed.select("a", "b").distinct())
        if first and proposed.isEmpty():
            first = False
            continue
        most, first = most if first else most * 8, False
        if proposed.isEmpty():
            if across or dealt.filter("chunks > 1").isEmpty():
                return links
            across = True
            continue
        checked = check_pairs(proposed, fetch, num, den)
        links = saved(links.union(checked.filter("ok").select("a", "b")))
        failed = saved(failed.union(checked.filter("not ok").select("a", "b")))
        release(spark)


#: Links that one task joins into components; more of them go through joins.
LOCAL_LINKS = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of the nodes of at most LOCAL_LINKS links: union by the smaller id."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            up.setdefault(u, u)
            up.setdefault(v, v)
            x, y = top(u), top(v)
            if x != y:
                up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_pydict({"id": pa.array(list(up), pa.int64()), "label": pa.array([top(x) for x in up], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every node of ``links`` (a, b): label is the smallest id of its component.

    Alternating large-star and small-star steps; each round's links are written
    to the shared checkpoint folder. Minima are pre-aggregated before they are
    shuffled, so a node with very many links is no single task's group. As soon
    as no more than LOCAL_LINKS links are left, one task of that bounded size
    ends the work.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] <= LOCAL_LINKS:
            return saved(map_arrow(edges.coalesce(1), _joined, "id long, label long"))
        if now == before:
            break
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .filter("u <> v").distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v") \
            .union(least2.select("u", F.col("m").alias("v")))
        edges = saved(small_.distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")) \
        .union(edges.select(F.col("v").alias("id"), F.col("v").alias("label"))).distinct()
