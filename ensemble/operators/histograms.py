"""What the tasks of boosted-tree fits do with a block of rows: bins, row samples, sums by bin, running predictions.

A partition of the training table is one block of NumPy arrays. Spark deals the rows to the
partitions, keeps the blocks, and adds up and searches the sums of each (model, node) in shuffled groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa

#: Up to so many rows of a node are summed over all columns at once: the calls would cost more than the sums.
FEW = 4096
PACKED = "bins binary, y binary, key binary, role binary"


@dataclass(frozen=True)
class Block:
    """Bins by feature and row, target, hash of the row's key, role, and the running predictions by model and row."""

    bins: np.ndarray
    y: np.ndarray
    key: np.ndarray
    role: np.ndarray
    pred: np.ndarray


@dataclass(frozen=True)
class Walk:
    """A tree over bins or values as arrays; a leaf leads to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def parts(self, values: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves that hold some of the rows, each with its rows in their order. A node reads one feature of its rows."""
        todo = [(0, rows)]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.left[node] == node:
                yield node, rows
                continue
            left = values[self.feature[node]].take(rows) <= self.cut[node].item()
            todo += [(int(self.right[node]), rows[~left]), (int(self.left[node]), rows[left])]

    def leaves(self, values: np.ndarray) -> np.ndarray:
        """The leaf of every row of a block or batch. A tree of few nodes moves all rows node by node, a byte a row and without
        an index, which is faster than to follow the rows of each node."""
        if len(self.feature) > 256:
            out = np.zeros(values.shape[1], dtype=np.int32)
            for leaf, rows in self.parts(values, np.arange(len(out))):
                out[rows] = leaf
            return out
        out = np.zeros(values.shape[1], dtype=np.uint8)
        for node in range(len(self.feature)):  # a node comes before its children
            left, right = int(self.left[node]), int(self.right[node])
            if left != node:
                here = out == node
                to_right = here > (values[self.feature[node]] <= self.cut[node].item())
                # differences modulo 256: a row that is not here moves by nothing
                out += here.view(np.uint8) * np.uint8((left - node) % 256)
                out += to_right.view(np.uint8) * np.uint8((right - left) % 256)
        return out

    def groups(self, bins: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """What ``parts`` gives for the rows of a block, in the order of the leaves."""
        if len(self.feature) == 1:
            yield 0, rows
            return
        leaf = self.leaves(bins).take(rows)
        ends = np.bincount(leaf, minlength=len(self.feature)).cumsum().tolist()
        rows = rows.take(leaf.argsort(kind="stable"))
        for node, (start, end) in enumerate(zip([0, *ends], ends)):
            if end > start:
                yield node, rows[start:end]


@dataclass(frozen=True)
class Work:
    """The nodes of one model whose splits are sought, and the features that each of them may split on."""

    model: int
    trains: tuple[int, ...]
    draw: int
    subsample: float
    walk: Walk
    columns: dict[int, tuple[int, ...]]


def seed_of(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """Uniform draws in [0, 1) from 64-bit keys and a seed (the finisher of splitmix64)."""
    z = key ^ np.uint64(seed)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(by)
    z ^= z >> np.uint64(31)
    z >>= np.uint64(11)
    return z / float(1 << 53)


def among(role: np.ndarray, roles: Sequence[int]) -> np.ndarray:
    """Which rows have one of the roles."""
    return reduce(or_, [role == r for r in roles], np.zeros(len(role), dtype=bool))


def few_values(features: Sequence[str], most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The distinct values of each feature in a task's rows, or some ``most`` of them if there are more."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0) for _ in features]
        for b in batches:
            for j, c in enumerate(features):
                if len(seen[j]) < most:
                    seen[j] = np.union1d(seen[j], b.column(c).to_numpy(zero_copy_only=False))[:most]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(seen), dtype=np.int32), [len(v) for v in seen])), pa.array(np.concatenate(seen))],
            ["feature", "value"])
    return run


def pack(features: Sequence[str], cuts: Sequence[np.ndarray], kind: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as packed arrays, one row for each batch; a value's bin is the number of cuts below it."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
                bins = np.stack([np.searchsorted(cut, col(c), side="left").astype(kind) for c, cut in zip(features, cuts)])
                packed = (bins, col("__y").astype("f8"), col("__key").astype("i8"), col("__role").astype("i2"))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], ["bins", "y", "key", "role"])
    return run


def blocks(n_features: int, kind: str, starts: Sequence[float]) -> Callable[[Iterable], Iterator[Block]]:
    """The packed rows of a partition as one block."""
    def run(rows: Iterable) -> Iterator[Block]:
        parts = [(np.frombuffer(r.bins, dtype=kind).reshape(n_features, -1), np.frombuffer(r.y, dtype="f8"),
                  np.frombuffer(r.key, dtype="i8").view(np.uint64), np.frombuffer(r.role, dtype="i2")) for r in rows]
        if parts:
            bins, y, key, role = (np.concatenate(x, axis=-1) for x in zip(*parts))
            yield Block(bins, y, key, role, np.repeat(np.array(starts, dtype="f8")[:, None], len(y), axis=1))
    return run


def moved(steps: Sequence[tuple[int, Walk, np.ndarray]]) -> Callable[[Iterable[Block]], Iterator[Block]]:
    """Blocks whose predictions have moved by the values of the models' new trees, given by node."""
    def run(parts: Iterable[Block]) -> Iterator[Block]:
        for b in parts:
            pred = b.pred.copy()
            for model, walk, by_node in steps:
                pred[model] += by_node.take(walk.leaves(b.bins))
            yield replace(b, pred=pred)
    return run


def sums(works: Sequence[Work], losses: Sequence[tuple[int, tuple[int, ...], tuple[int, ...]]], bins: int) \
        -> Callable[[Iterable[Block]], Iterator[tuple[tuple[int, int], np.ndarray]]]:
    """For each (model, node) the number and the sum of residuals of its sampled training rows by column of the node and bin,
    and for each (model, -1) of ``losses`` the number and the sum of squares of training and of validation rows.

    Models that draw the same rows share the draw. The rows of a node are taken together, in their order, so that
    sums run over its own columns only and stay in the fastest memory."""
    def run(parts: Iterable[Block]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        total: dict[tuple[int, int], np.ndarray] = {}

        def add(key: tuple[int, int], x: np.ndarray) -> None:
            total[key] = total[key] + x if key in total else x
        for b in parts:
            of_roles = lru_cache(None)(lambda roles, b=b: among(b.role, roles))
            sampled = lru_cache(None)(lambda draw, share, b=b: uniform(b.key, draw) < share)
            for model, trains, checks in losses:
                square = (b.y - b.pred[model]) ** 2
                add((model, -1), np.array([v for x in map(of_roles, (trains, checks)) for v in (float(x.sum()), float(square[x].sum()))]))
            for w in works:
                rest = b.y - b.pred[w.model]
                for node, rows in w.walk.groups(b.bins, np.flatnonzero(of_roles(w.trains) & sampled(w.draw, w.subsample))):
                    if node in w.columns:
                        add((w.model, node), by_bin(b.bins, rows, rest.take(rows), w.columns[node], bins))
        yield from total.items()
    return run


def by_bin(binned: np.ndarray, rows: np.ndarray, rest: np.ndarray, columns: Sequence[int], bins: int) -> np.ndarray:
    """The number of the rows and the sum of their residuals by column and bin."""
    out = np.empty((len(columns), 2, bins))
    if len(rows) <= FEW:
        slot = (binned[np.ix_(columns, rows)] + bins * np.arange(len(columns))[:, None]).ravel()
        out[:, 0] = np.bincount(slot, minlength=len(columns) * bins).reshape(-1, bins)
        out[:, 1] = np.bincount(slot, weights=np.tile(rest, len(columns)), minlength=len(columns) * bins).reshape(-1, bins)
        return out
    for j, f in enumerate(columns):
        slot = binned[f].take(rows).astype(np.intp)
        out[j, 0] = np.bincount(slot, minlength=bins)
        out[j, 1] = np.bincount(slot, weights=rest, minlength=bins)
    return out


@dataclass(frozen=True)
class Split:
    """The best split of a node (feature -1: none), with rows and sums of residuals on both sides (or of the node)."""

    feature: int
    cut: int
    left: tuple[int, float]
    right: tuple[int, float]


def best_split(hist: np.ndarray, columns: Sequence[int]) -> Split:
    """The split of the largest fall of the residuals' variance, from the sums by column; the first of equal ones."""
    n, s = hist[:, 0].cumsum(axis=1), hist[:, 1].cumsum(axis=1)
    rows, total = n[0, -1], s[0, -1]
    left, right = n[:, :-1], rows - n[:, :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = s[:, :-1] ** 2 / left + (total - s[:, :-1]) ** 2 / right
    parts = np.where((left > 0) & (right > 0), parts, -np.inf)
    j, cut = np.unravel_index(int(parts.argmax()), parts.shape)
    # a difference below the rounding of the sums is no gain
    if rows == 0 or not parts[j, cut] - total ** 2 / rows > 1e-12 * parts[j, cut]:
        return Split(-1, 0, (int(rows), float(total)), (0, 0.0))
    ln, ls = int(n[j, cut]), float(s[j, cut])
    return Split(columns[j], int(cut), (ln, ls), (int(rows) - ln, float(total - s[j, cut])))


def found(columns: dict[tuple[int, int], tuple[int, ...]]) -> Callable[[tuple], tuple]:
    """The best split of a (model, node) from its sums; sums of squares as they are."""
    def run(item: tuple) -> tuple:
        key, x = item
        return key, x if key[1] < 0 else best_split(x, columns[key])
    return run
