"""N-gram Jaccard join by PartEnum signatures (operator 1).

A document's set holds its distinct word shingles. Sets are put into size bands
so that two sets with similarity num/den or more lie in the same band or in
neighbouring ones; for each such pair of bands the similarity bounds how many
elements two sets can differ in, k. The feature domain is cut into n1 = (k+1)/2
parts, so that in at least one part the two sets differ in one element at most;
each part is cut into three, and each choice of two of the three is a signature:
one differing element leaves one choice untouched, so sufficiently similar sets
share a signature for certain. Candidates are then checked exactly.

Exact copies are folded into classes first; links are reported through the
components they make, so no pairs of copies are ever expanded.

Defined cases: a null or empty text, or one of white space, has an empty set and
links with nothing; a text with fewer words than the shingle has its whole word
sequence as its one shingle; repeated rows each get a row; a null doc_id is kept
as null and takes no part in the smallest id; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import batches_of, map_arrow, release, saved, small
from .similar import components, links_of_groups, parity, sketch_bits

_U = np.uint64
THIRDS = 3


def band_tops(num: int, den: int, largest: int = 1 << 34) -> np.ndarray:
    """Largest size of each band; a band ends where its first size times den/num does."""
    out, low = [], 1
    while low < largest:
        out.append(max(low, low * den // num))
        low = out[-1] + 1
    return np.array(out, np.int64)


def signatures(flat: np.ndarray, n: np.ndarray, num: int, den: int, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, position of the set each belongs to) of sets given end to end; n: sizes, not 0."""
    band = np.searchsorted(tops, n)
    owner_of = np.repeat(np.arange(len(n)), n)
    mixed = W.mix(flat)
    lo32, hi32 = (mixed & _U(0xFFFFFFFF)).astype(np.float64), (mixed >> _U(32)).astype(np.float64)
    third = ((flat >> _U(32)) % _U(THIRDS)).astype(np.int64)
    sigs, owners = [], []
    for step in (0, 1):  # a band is joined with the one below it and with the one above it
        inst = band + step
        k = 2 * tops[inst] * (den - num) // (den + num)
        n1 = (k + 2) // 2
        base = np.cumsum(n1 * THIRDS) - n1 * THIRDS
        cells = int((n1 * THIRDS).sum())
        part = (flat % n1[owner_of].astype(np.uint64)).astype(np.int64)
        cell = base[owner_of] + part * THIRDS + third
        # sums below 2**53 are exact: a set's content in a cell, whatever its order
        low = np.bincount(cell, weights=lo32, minlength=cells).astype(np.uint64)
        high = np.bincount(cell, weights=hi32, minlength=cells).astype(np.uint64)
        c = W.mix(low + W.mix(high)).reshape(-1, THIRDS)
        owner = np.repeat(np.arange(len(n)), n1)
        where = (np.arange(len(owner)) - np.repeat(np.cumsum(n1) - n1, n1)).astype(np.uint64)
        seed = W.mix(where * _U(0x9E3779B97F4A7C15) + inst[owner].astype(np.uint64))
        for drop in range(THIRDS):
            a, b = (x for x in range(THIRDS) if x != drop)
            sigs.append(W.mix(W.mix(c[:, a] + seed) * _U(0xD6E8FEB86659FD93) + c[:, b] + _U(drop)))
            owners.append(owner)
    return np.concatenate(sigs), np.concatenate(owners)


def _sets(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets) of runs of rows."""
    for first, end, h, off in W.batch_words(b.column("text")):
        yield first, [W.shingles(h[off[i] : off[i + 1]], k) for i in range(end - first)]


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _class(s: np.ndarray) -> int:
    return int.from_bytes(_key(s)[:8], "little", signed=True)


def _keys(k: int):
    def run(batches):
        for b in batches:
            keys, ids, sizes = [], [], []
            for _, sets in _sets(b, k):
                keys += [_key(s) for s in sets]
                ids += [_class(s) if len(s) else None for s in sets]
                sizes += [len(s) for s in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "key": pa.array(keys, pa.binary()),
                                              "id": pa.array(ids, pa.int64()),
                                              "n_shingles": pa.array(sizes, pa.int64())})
    return run


def _signed(k: int, num: int, den: int, part: int = 0, parts: int = 1):
    """Signatures of one of ``parts`` shares of all signatures."""
    def run(batches):
        tops = band_tops(num, den)
        for b in batches:
            for _, sets in _sets(b, k):
                sets = [s for s in sets if len(s)]
                if not sets:
                    continue
                ids = np.array([_class(s) for s in sets], np.int64)
                sig, owner = signatures(np.concatenate(sets), np.array([len(s) for s in sets]), num, den, tops)
                if parts > 1:
                    mine = (sig >> _U(32)) % _U(parts) == _U(part)
                    sig, owner = sig[mine], owner[mine]
                yield pa.RecordBatch.from_pydict({"sig": sig.view(np.int64), "id": ids[owner]})
    return run


def _listed(k: int):
    def run(batches):
        for b in batches:
            for _, sets in _sets(b, k):
                sets = [s for s in sets if len(s)]
                if sets:
                    yield pa.RecordBatch.from_pydict({"id": pa.array([_class(s) for s in sets], pa.int64()),
                                                      "toks": pa.array([s.tobytes() for s in sets], pa.binary())})
    return run


def _sketched(k: int, num: int, den: int):
    def run(batches):
        for b in batches:
            for _, sets in _sets(b, k):
                sets = [s for s in sets if len(s)]
                if sets:
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array([_class(s) for s in sets], pa.int64()), "size": pa.array([len(s) for s in sets], pa.int64()),
                        "sketch": pa.array([parity(s, sketch_bits(len(s), num, den)) for s in sets], pa.binary())})
    return run


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def labelled_rows(docs: DataFrame, k: int, num: int, den: int, parts: int = 1) -> DataFrame:
    """doc_id, text_key, n_shingles, class_id, label of every row; linked documents share a label,
    others never do, whatever their doc_ids (null for empty sets).

    Signatures are shuffled in ``parts`` shares one after another, each let go before the next:
    the same groups with so much less on disk at once, for as many more passes over the texts."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    own = saved(map_arrow(texts.withColumn("text_key", _text_key()), _keys(k),
                          "doc_id long, text_key long, key binary, id long, n_shingles long"))
    classes = saved(own.filter("n_shingles > 0").groupBy("key", "id").agg(F.min("doc_id").alias("rep")))
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    copies = own.select("doc_id").filter("doc_id is not null").distinct().join(reps, "doc_id", "left_anti")
    alone = texts.join(small(copies), "doc_id", "left_anti")
    w = Window.partitionBy("sig")
    # the ids of a group add up: repeated rows, which bring an id into a group twice, do not cancel (halves of 32 bits, so that no sum overflows)
    h = F.xxhash64("id")
    content = F.xxhash64(F.sum(F.shiftright(h, 32)).over(w), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).over(w))
    shared = None
    for part in range(parts):
        sigs = map_arrow(alone, _signed(k, num, den, *((part, parts) if parts > 1 else ())), "sig long, id long")
        some = saved(sigs.select("sig", "id", F.min("id").over(w).alias("lo"), F.max("id").over(w).alias("hi"),
                                 F.count("*").over(w).alias("n"), content.alias("x")).filter("lo <> hi"))
        shared = some if shared is None else shared.union(some)
        release(spark)
    # groups with the same members are one group
    kept = shared.groupBy("lo", "hi", "n", "x").agg(F.min("sig").alias("sig")).select("sig")
    members = saved(shared.join(kept, "sig").select(F.col("sig").alias("gid"), "id").distinct())
    def of_classes(ids: DataFrame) -> DataFrame:
        """Texts of the representatives of the classes asked for."""
        wanted = classes.join(ids, "id").select(F.col("rep").alias("doc_id")).distinct()
        return texts.alias("t").join(small(wanted).alias("r"), F.expr("t.doc_id <=> r.doc_id"), "left_semi")

    sketches = saved(map_arrow(of_classes(members.select("id").distinct()), _sketched(k, num, den), "id long, size long, sketch binary")
                     .dropDuplicates(["id"]))
    links = links_of_groups(members, sketches, lambda ids: map_arrow(of_classes(ids), _listed(k), "id long, toks binary"), num, den)
    label = components(links)
    numbered = own.select("doc_id", "text_key", "n_shingles", F.col("id").alias("class_id"))
    return numbered.join(label.withColumnRenamed("id", "class_id"), "class_id", "left") \
        .withColumn("label", F.coalesce("label", "class_id"))


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, text_key of every row of ``docs`` (doc_id, text).

    Two documents link where den * |A and B| >= num * |A or B| of their k-word
    shingles. component_id: smallest doc_id reachable by links; class_id:
    documents with equal sets share it (null for empty sets); text_key: a hash of the text.
    """
    labelled = labelled_rows(docs, k, num, den)
    least = labelled.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least, "label", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class_id", "text_key")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of linked documents, all columns as they are: that of the smallest
    doc_id (null ids last; of rows with that id, the one with the smaller hash of its text; of equal
    rows, one). Groups are told apart by their links alone: a doc_id may occur with unrelated texts."""
    with batches_of(docs.sparkSession, 512 << 10):
        found = saved(labelled_rows(docs, k, num, den, parts=3).filter("n_shingles > 0").select("doc_id", "text_key", "label"))
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"))
    chosen = found.join(first, "label").select("doc_id", "text_key", F.expr("doc_id <=> first.doc_id and text_key = first.text_key").alias("stays"))
    shape = chosen.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    other = small(saved(shape.filter("not stays or n > 1")))
    keyed = docs.withColumn("_text_key", _text_key())
    same = F.expr("cast(d.doc_id as long) <=> o.doc_id and d._text_key = o.text_key")
    alone = keyed.alias("d").join(other.alias("o"), same, "left_anti")
    repeated = keyed.alias("d").join(other.filter("stays").alias("o"), same, "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return alone.union(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
