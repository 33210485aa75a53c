"""Benchmark decontamination by BM25 retrieval (operator 3).

Test items are cut into entries of at most ``ENTRY`` words and put into an
inverted index with BM25 weights, each divided by its entry's score for itself,
so that an entry's score for a passage is the weighted share of it that the
passage holds. Every passage of every document (windows of twice ENTRY words, at
steps of ENTRY, so that each entry's words lie in one window whole) is a query,
and all entries above the threshold are retrieved. Bounds skip the rest without
loss, as in block-max WAND: terms that together cannot lift any entry to the
threshold never make a candidate by themselves; a window is looked at only where
its other terms could; then only blocks of entries whose block maxima reach the
threshold are scored. Retrieved items are verified against the document around
the window: the share of the question's five-word shingles and of the answer's
words found there must both reach ``verify``.

The index is built by Spark; a shard of it that goes to the executors has a
bounded size, and more items mean more shards, each probed against all
documents.

Defined cases: words are runs of letters and digits, lower-cased; an item's
answer is its last sentence (the last quarter of its words if it has one
sentence); items without words match nothing; null or empty texts hold nothing;
repeated rows are judged one by one; empty tables give no matches; other columns
are passed through by ``drop_contaminated`` and ignored elsewhere. Of several
windows that hold an item, the one with the best score is reported (the first
of equals).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import map_arrow, saved

ENTRY, BLOCK = 64, 8
#: Cells of a bounds table (windows by blocks) that are summed at once.
CELLS = 1 << 22
K1, B = 1.2, 0.75
#: Bytes of item text whose index goes to the executors at once.
SHARD_BYTES = 8 << 20
_U = np.uint64
_SENTENCE = re.compile(r"[.!?\n]+")


def _words(text: str) -> np.ndarray:
    lower = pc.utf8_lower(pa.scalar(text or "", pa.string())).as_py()
    return W.word_hashes(W.PLAIN[np.frombuffer(lower.encode(), np.uint8)])


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an item's question and answer."""
    parts = [w for w in map(_words, _SENTENCE.split(text or "")) if len(w)]
    if not parts:
        return np.zeros(0, _U), np.zeros(0, _U)
    whole = np.concatenate(parts)
    n = len(parts[-1]) if len(parts) > 1 else max(1, len(whole) // 4)
    return (whole[:-n], whole[-n:]) if n < len(whole) else (whole, whole)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, entry, term, tf, size) of the items' entries."""
    for b in batches:
        out = {"item": [], "entry": [], "term": [], "tf": [], "size": []}
        for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
            w = np.concatenate(question_and_answer(text)) if _words(text).size > 1 else _words(text)
            for no, at in enumerate(range(0, len(w), ENTRY)):
                term, tf = np.unique(w[at : at + ENTRY], return_counts=True)
                out["item"] += [item] * len(term)
                out["entry"] += [no] * len(term)
                out["term"] += term.view(np.int64).tolist()
                out["tf"] += tf.tolist()
                out["size"] += [min(ENTRY, len(w) - at)] * len(term)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("item", pa.int64()), ("entry", pa.int32()), ("term", pa.int64()), ("tf", pa.int32()), ("size", pa.int32())]))


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The ranges start..end-1, one after the other."""
    k = end - start
    return np.arange(int(k.sum())) + np.repeat(start - (np.cumsum(k) - k), k)


class Index:
    """One shard of the inverted index, with the bounds and the items' words for verification."""

    def __init__(self, rows: list, texts: dict[int, str], threshold: float):
        self.threshold = threshold
        entries = sorted({(r.item, r.entry) for r in rows})
        at = {e: i for i, e in enumerate(entries)}
        self.entry_item = np.array([i for i, _ in entries], np.int64)
        entry = np.array([at[r.item, r.entry] for r in rows], np.int64)
        weight = np.array([r.weight for r in rows], float)
        own = np.bincount(entry, weights=weight, minlength=len(entries))
        weight = weight / own[entry]
        self.terms, term = np.unique(np.array([r.term for r in rows], np.int64).view(_U), return_inverse=True)
        order = np.lexsort((entry, term))
        self.entry, self.weight, term = entry[order], weight[order], term[order]
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.most = np.zeros(len(self.terms))
        np.maximum.at(self.most, term, self.weight)
        self.n_blocks = -(-len(entries) // BLOCK)
        key, where = np.unique(term * self.n_blocks + self.entry // BLOCK, return_inverse=True)
        self.block_most = np.zeros(len(key))
        np.maximum.at(self.block_most, where, self.weight)
        self.block_of, self.block_start = key % max(1, self.n_blocks), np.searchsorted(key // max(1, self.n_blocks), np.arange(len(self.terms) + 1))
        # the terms of most entries are set aside while no entry can reach half the threshold with them
        spread = np.argsort(-np.diff(self.start), kind="stable")
        aside = np.zeros(len(entries))
        self.essential = np.ones(len(self.terms), dtype=bool)
        for t in spread:
            e, w = self.entry[self.start[t] : self.start[t + 1]], self.weight[self.start[t] : self.start[t + 1]]
            if (aside[e] + w).max() > threshold / 2:
                continue
            aside[e] += w
            self.essential[t] = False
        self.needed = threshold - aside.max(initial=0.0)
        self.weighty = np.append(self.essential, False)  # the last stands for unknown words
        bits = 22
        self.mask = _U((1 << bits) - 1)
        self.slot = np.full(1 << bits, -1, np.int32)
        slot = (self.terms & self.mask).astype(np.int64)
        self.slot[slot] = np.arange(len(self.terms))
        shared = np.flatnonzero(np.bincount(slot, minlength=1 << bits) > 1)
        self.slot[shared] = -2  # to be searched
        self.items = {}
        for item, text in texts.items():
            q, a = question_and_answer(text)
            if len(q):
                self.items[item] = (W.shingles(q, min(5, len(q))), min(5, len(q)), np.unique(a), len(q) + len(a))

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 if unknown."""
        if not len(self.terms):
            return np.full(len(h), -1, np.int32)
        t = self.slot[(h & self.mask).astype(np.int64)]
        odd = np.flatnonzero(t == -2)
        t[odd] = np.minimum(np.searchsorted(self.terms, h[odd]), len(self.terms) - 1)
        return np.where((t >= 0) & (self.terms[t] == h), t, -1)

    def windows(self, t: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, end) of the windows in which the block maxima of the essential terms
        could lift an entry of some block to the threshold."""
        n = np.diff(off)
        count = np.maximum(1, -(-(n - ENTRY) // ENTRY))
        base = np.cumsum(count) - count
        doc = np.repeat(np.arange(len(n)), count)
        first = off[doc] + (np.arange(len(doc)) - base[doc]) * ENTRY
        end = np.minimum(first + 2 * ENTRY, off[doc + 1])
        at = np.flatnonzero(self.weighty[t])
        if not len(at):
            return doc[:0], first[:0], end[:0]
        owner = np.searchsorted(off, at, side="right") - 1
        step = (at - off[owner]) // ENTRY
        # a word lies in the window that starts at its step and in the one before
        now, before = step < count[owner], step > 0
        window = np.concatenate([(base[owner] + step)[now], (base[owner] + step - 1)[before]])
        term = np.concatenate([t[at][now], t[at][before]])
        order = np.argsort(window, kind="stable")
        window, term = window[order], term[order]
        ok = np.zeros(len(doc), dtype=bool)
        rows = max(1, CELLS // max(1, self.n_blocks))
        for lo in range(0, len(doc), rows):
            a, z = np.searchsorted(window, [lo, lo + rows])
            some = term[a:z]
            k = self.block_start[some + 1] - self.block_start[some]
            take = _ranges(self.block_start[some], self.block_start[some + 1])
            here = min(rows, len(doc) - lo)
            cell = np.repeat(window[a:z] - lo, k) * self.n_blocks + self.block_of[take]
            upper = np.bincount(cell, weights=self.block_most[take], minlength=here * self.n_blocks)
            ok[lo : lo + here] = (upper.reshape(here, -1) >= self.needed - 1e-9).any(axis=1)
        return doc[ok], first[ok], end[ok]

    def retrieve(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, scores) at the threshold or above for one window's terms."""
        t = np.unique(t)
        t = t[t >= 0]
        none = np.zeros(0, np.int64), np.zeros(0)
        ess = t[self.essential[t]]
        if self.most[ess].sum() < self.needed - 1e-9:
            return none
        at = _ranges(self.block_start[t], self.block_start[t + 1])
        upper = np.bincount(self.block_of[at], weights=self.block_most[at], minlength=self.n_blocks)
        live = upper >= self.threshold - 1e-9
        if not live.any():
            return none
        at = _ranges(self.start[t], self.start[t + 1])
        at = at[live[self.entry[at] // BLOCK]]
        score = np.bincount(self.entry[at], weights=self.weight[at], minlength=len(self.entry_item))
        hit = np.flatnonzero(score >= self.threshold - 1e-9)
        return hit, score[hit]

    def matches(self, col: pa.Array, verify: float) -> Iterator[tuple[int, int, int, float, float, float]]:
        """(row, item, first word, score, question share, answer share) of verified items."""
        for row, _, h, off in W.batch_words(pc.utf8_lower(col), W.PLAIN):
            t = self.look_up(h)
            found: dict[tuple[int, int], tuple[float, int, float, float]] = {}
            for doc, first, end in zip(*(x.tolist() for x in self.windows(t, off))):
                for e, score in zip(*self.retrieve(t[first:end])):
                    item = int(self.entry_item[e])
                    shingles, k, answer, size = self.items[item]
                    near = h[max(int(off[doc]), first - size) : min(int(off[doc + 1]), end + size)]
                    q = float(np.isin(shingles, W.shingles(near, k)).mean()) if len(near) >= k else 0.0
                    a = float(np.isin(answer, near).mean())
                    if q >= verify and a >= verify and (found.get((doc, item), (-1.0,))[0] < score - 1e-12):
                        found[doc, item] = (float(score), first - int(off[doc]), q, a)
            for (doc, item), (score, first, q, a) in found.items():
                yield row + doc, item, first, score, q, a


def build(items: DataFrame, threshold: float) -> Iterator[Index]:
    """Index shards of ``items`` (item_id, text), each of bounded size."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).distinct()
    # one number per distinct row: an item given with several texts counts as several
    rows = saved(rows.withColumn("item", F.xxhash64("item_id", "text")))
    entries = saved(map_arrow(rows.select("item", "text"), _entries, "item long, entry int, term long, tf int, size int"))
    shape = entries.select("item", "entry", "size").distinct().agg(F.count("*").alias("n"), F.avg("size").alias("size")).first()
    if not shape["n"]:
        return
    df = entries.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(shape["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(shape["size"])))
    weighted = saved(entries.join(df, "term").select("item", "entry", "term", weight.alias("weight")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    for s in range(shards):
        here = F.pmod(F.col("item"), F.lit(shards)) == s
        texts = rows.filter(here).collect()
        index = Index(weighted.filter(here).collect(), {r.item: r.text for r in texts}, threshold)
        index.ids = {r.item: r.item_id for r in texts}
        yield index


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.5, verify: float = 0.6) -> DataFrame:
    """doc_id, item_id, first_word, bm25, question_overlap, answer_overlap of every verified pair."""
    schema = "doc_id long, item_id long, first_word int, bm25 double, question_overlap double, answer_overlap double"
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    out = spark.createDataFrame([], schema)
    for index in build(items, threshold):
        out = out.unionByName(map_arrow(texts, _pairs(spark.sparkContext.broadcast(index), verify), schema))
    return out


def _pairs(shared, verify: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            got = list(index.matches(b.column("text"), verify))
            if got:
                row, item, first, score, q, a = zip(*got)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").take(pa.array(row)), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(first, pa.int32()),
                    pa.array(score), pa.array(q), pa.array(a)],
                    names=["doc_id", "item_id", "first_word", "bm25", "question_overlap", "answer_overlap"])
    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, verify: float = 0.6) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns as they are."""
    def without(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[m[0] for m in shared.value.matches(b.column("text"), verify)]] = False
                yield b.filter(pa.array(keep))
        return run

    for index in build(items, threshold):
        docs = map_arrow(docs, without(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs
