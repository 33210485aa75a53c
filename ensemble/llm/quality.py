"""Quality classifier on random Fourier features (operator 2).

Statistics of whole texts (lengths, byte classes, word and line shapes,
repetition, entropy) are standardised and mapped to random Fourier features,
which approximate a Gaussian kernel. Ridge scores come from normal equations
that every partition sums for itself; the sums have a fixed size, whatever the
input. Isotonic regression on a fixed number of score bins turns scores into
probabilities. Labels, language, source and doc_id are never inputs of a score.

Defined cases: a null or empty text has all statistics 0 and a score like any
other; labels given more than once for a doc_id are averaged, null labels and
labels without a document are left out; without any usable label every score is
0.5; repeated rows are scored one by one; an empty table gives no rows; other
columns are passed through by ``keep_good`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import crc_mod, map_arrow, saved

N_RANDOM = 256
#: Width of the kernel in standardised units, ridge penalty per row, score bins of the calibration.
WIDTH, RIDGE, BINS = 4.0, 1e-4, 2048
#: Partitions that sum normal equations (each gives one table of N_RANDOM + 1 rows).
SUMMING = 64
LOW, HIGH = -0.5, 1.5

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256),
    "space": [32, 9], "line": [10, 13], "stop": map(ord, ".,;:!?'\"()-"), "sign": map(ord, "#$%&*+/<=>@[\\]^_`{|}~"),
}
_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _v in enumerate(_CLASSES.values()):
    _CLASS[list(_v), _k] = 1
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
N_STATS = 22


def _stats(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Statistics of texts that lie in buf at ``at`` with ``size`` bytes (white space between them)."""
    n = len(size)
    out = np.zeros((n, N_STATS))
    row = np.repeat(np.arange(n), size)
    inside = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    body = buf[inside]
    byte = np.bincount(row * 256 + body, minlength=n * 256).reshape(n, 256).astype(float)
    total = np.maximum(size, 1).astype(float)
    share = byte @ _CLASS / total[:, None]
    p = byte / total[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(axis=1)

    h, start, end = W.spans(buf)
    owner = np.searchsorted(at, start, side="right") - 1
    words = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = (end - start).astype(float)
    per = lambda x: np.bincount(owner, weights=x, minlength=n) / some
    mean = per(length)
    spread = np.sqrt(np.maximum(per(length**2) - mean**2, 0))
    first, last = buf[start], buf[end - 1]
    upper = (first >= 65) & (first <= 90)
    order = np.lexsort((h, owner))
    ho, oo = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
    distinct = np.bincount(oo[new], minlength=n)
    cut = np.flatnonzero(new)
    times = np.diff(np.append(cut, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, oo[cut], times)
    pair = W.mix(h[1:] + W.mix(h[:-1]))
    inner = owner[1:] == owner[:-1]
    po, ph = owner[1:][inner], pair[inner]
    order = np.lexsort((ph, po))
    ph, po2 = ph[order], po[order]
    fresh = np.ones(len(ph), dtype=bool)
    fresh[1:] = (ph[1:] != ph[:-1]) | (po2[1:] != po2[:-1])
    pairs = np.maximum(np.bincount(po2, minlength=n), 1)
    lines = byte[:, 10] + 1

    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(words), np.log1p(lines)
    out[:, 3], out[:, 4], out[:, 5] = mean, spread, entropy
    out[:, 6 : 6 + share.shape[1]] = share
    out[:, 14] = distinct / some
    out[:, 15] = top / some
    out[:, 16] = np.bincount(po2[fresh], minlength=n) / pairs
    out[:, 17] = per((~_ALNUM[last]).astype(float))
    out[:, 18] = per(upper.astype(float))
    out[:, 19] = per((length <= 2).astype(float))
    out[:, 20] = per((~_ALNUM[first]).astype(float))
    out[:, 21] = np.log1p(words / lines)
    out[size == 0] = 0
    return out


def statistics(col: pa.Array) -> np.ndarray:
    """One row of N_STATS statistics for each text of a column; nulls count as empty."""
    body, off = W.byte_view(col)
    n, out, row = len(off) - 1, [], 0
    while row < n:
        end = max(row + 1, min(n, int(np.searchsorted(off, off[row] + W.SEGMENT, side="right")) - 1))
        size = np.diff(off[row : end + 1])
        buf = np.full(int(size.sum()) + len(size), 32, np.uint8)
        at = np.cumsum(size + 1) - (size + 1)
        keep = np.ones(len(buf), dtype=bool)
        keep[at + size] = False
        buf[keep] = body[off[row] : off[end]]
        out.append(_stats(buf, at, size))
        row = end
    return np.concatenate(out) if out else np.zeros((0, N_STATS))


@dataclass
class Model:
    """A fitted classifier; everything in it has a fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(7)
        omega = rng.standard_normal((N_STATS, N_RANDOM)) / WIDTH
        phase = rng.uniform(0, 2 * np.pi, N_RANDOM)
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / N_RANDOM) * np.cos(x @ omega + phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(stats[i : i + 4096]) @ self.weights for i in range(0, len(stats), 4096)]) \
            if len(stats) else np.zeros(0)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of y with weights w (x ascending): pool adjacent violators."""
    blocks: list[list[float]] = []
    for v, k in zip(y, w):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, k2, n2 = blocks.pop()
            v1, k1, n1 = blocks.pop()
            blocks.append([(v1 * k1 + v2 * k2) / (k1 + k2), k1 + k2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, N_STATS)


def stats_table(docs: DataFrame) -> DataFrame:
    """doc_id, stats of every row (written once; the texts are read for this only)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = statistics(b.column("text"))
            arr = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, N_STATS, dtype=np.int32)), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), arr], names=["doc_id", "stats"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return saved(map_arrow(texts, run, "doc_id long, stats array<double>"))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on the rows of ``stats`` (doc_id, stats) that ``labels`` (doc_id, quality) marks."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")) \
        .filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    train = saved(stats.join(known, "doc_id").select("stats", "y").coalesce(SUMMING))
    moments = train.select(*[F.avg(F.col("stats")[i]) for i in range(N_STATS)],
                           *[F.stddev_pop(F.col("stats")[i]) for i in range(N_STATS)], F.count("*"), F.avg("y")).first()
    n = moments[-2]
    if not n:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(N_RANDOM + 1), np.array([0.0]), np.array([0.5]))
    scale = np.array(moments[N_STATS : 2 * N_STATS], float)
    model = Model(np.array(moments[:N_STATS], float), np.where(scale > 1e-9, scale, 1.0),
                  np.zeros(N_RANDOM + 1), np.array([0.0]), np.array([0.5]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((N_RANDOM + 1, N_RANDOM + 2))
        for b in batches:
            z = model.features(_matrix(b, "stats"))
            total += np.hstack([z.T @ z, (z.T @ b.column("y").to_numpy())[:, None]])
        yield pa.RecordBatch.from_pydict({"i": np.arange(N_RANDOM + 1, dtype=np.int32), "v": list(total)})

    parts = map_arrow(train, sums, "i int, v array<double>")
    # the parts meet as N_RANDOM + 1 rows of each of SUMMING partitions at most
    rows = parts.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((N_RANDOM + 1, N_RANDOM + 2))
    for r in rows:
        total[r.i, r.j] = r.x
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * n * np.eye(N_RANDOM + 1), total[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.clip(model.raw(_matrix(b, "stats")), LOW, HIGH)
            at = np.minimum((raw - LOW) / (HIGH - LOW) * BINS, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": at, "raw": raw, "y": b.column("y")})

    bins = map_arrow(train, binned, "bin int, raw double, y double").groupBy("bin") \
        .agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.knots = np.array([r.raw for r in bins])
    model.values = isotonic(model.knots, np.array([r.y for r in bins]), np.array([float(r.n) for r in bins]))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from rows outside the held fold only."""
    stats = stats_table(docs)
    fold = crc_mod(F.col("doc_id"), folds)
    model = fit(stats, labels.filter(fold != held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": model.score(_matrix(b, "stats"))})

    return map_arrow(stats, run, "doc_id long, score double").select(
        "doc_id", (fold == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, all columns as they are."""
    model = fit(stats_table(docs), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(statistics(b.column("text"))) >= least))

    return map_arrow(docs, run, docs.schema)
