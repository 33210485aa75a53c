import random

import numpy as np
import pyarrow as pa
import pytest

from brute import components, documents, frame
from ensemble.llm import common, jaccard_join as J, similar as S, words as W


def key(x):
    return tuple((v is not None, v) for v in x)


def test_signatures_are_shared_by_similar_sets():
    rnd = np.random.default_rng(5)
    tops = J.band_tops(90, 100)
    for size in (1, 5, 9, 10, 11, 40, 333, 2000):
        for _ in range(30):
            a = rnd.integers(0, 2**63, size, dtype=np.uint64)
            b = a.copy()
            change = rnd.integers(0, max(1, size // 18) + 1)
            b[:change] = rnd.integers(0, 2**63, change, dtype=np.uint64)
            a, b = np.unique(a), np.unique(b)
            if S.similar(a, b, 90, 100):
                sig = [set(J.signatures(s, np.array([len(s)]), 90, 100, tops)[0].tolist()) for s in (a, b)]
                assert sig[0] & sig[1]


def test_sketch_bounds_the_distance():
    rnd = np.random.default_rng(6)
    a = np.unique(rnd.integers(0, 2**63, 500, dtype=np.uint64))
    b = np.unique(np.concatenate([a[20:], rnd.integers(0, 2**63, 15, dtype=np.uint64)]))
    x, y = (np.frombuffer(S.parity(s, 2048), np.uint64) for s in (a, b))
    assert int(np.bitwise_count(x ^ y).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))


@pytest.mark.parametrize("chunk,k,num", [(4 << 20, 3, 90), (512, 5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, chunk, k, num):
    monkeypatch.setattr(S, "CHUNK_BYTES", chunk)
    rows = documents()
    want, sizes = components(rows, k, num, 100)
    got = J.jaccard_components(frame(spark, rows), k, num, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == \
        sorted(((d, n, c) for (d, _), n, c in zip(rows, sizes, want)), key=key)


def test_keep_one(spark):
    rows = documents()
    want, sizes = components(rows, 5, 80, 100)
    got = J.keep_one(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    # one row of each group, that of its smallest doc_id; texts without words all stay
    with_words = sorted((d, t) for (d, t), n in zip(rows, sizes) if n and d is not None)
    first = {c: next(t for d, t in with_words if d == c) for c, n in zip(want, sizes) if n and c is not None}
    assert sorted((d, t) for d, t in kept if d is not None and t and t.split()) == sorted(first.items())
    assert sum(not (t or "").split() for _, t in kept) == sum(n == 0 for n in sizes)


@pytest.mark.parametrize("local", [500_000, 5])
def test_empty_table_and_components_of_a_path(spark, monkeypatch, local):
    monkeypatch.setattr(S, "LOCAL_LINKS", local)
    assert J.jaccard_components(frame(spark, [])).collect() == []
    order = list(range(1, 60))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([(i, i + 1) for i in order] + [(100, 101)], "a long, b long")
    got = {r.id: r.label for r in S.components(links).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def _near(n, at):
    """Texts of n distinct words, one of them another at each of the given places."""
    return [" ".join(f"w{i}" if i != j else f"other{j}" for i in range(n)) for j in at]


def test_keep_one_where_doc_ids_repeat(spark):
    """Groups that share a doc_id, or have none, are told apart: one row of each stays."""
    b, lone, nulls = _near(80, (0, 79, None)), "text a of the same id " * 3, ["null " + t for t in _near(60, (0, 59))]
    rows = [(7, lone), (7, b[0]), (9, b[1]), (12, b[2]), (7, lone), (None, nulls[0]), (None, nulls[1])]
    want, _ = components([(i, t) for i, (_, t) in enumerate(rows)], 5, 80, 100)
    kept = [(r.doc_id, r.text) for r in J.keep_one(frame(spark, rows)).collect()]
    assert sorted(want[rows.index(r)] for r in kept) == sorted(set(want)) and len(set(want)) == 3
    assert {r for r in kept if r[0] is not None} == {(7, lone), (7, b[0])}


def test_rows_given_twice_keep_their_links(spark, monkeypatch):
    """Two signature groups that differ in one member alone, every row given twice, are two groups."""
    texts = sorted(_near(100, (0, 1, 98, 99)), key=lambda t: J._class(W.shingles(next(W.batch_words(pa.array([t])))[2], 3)))
    ids = [J._class(W.shingles(next(W.batch_words(pa.array([t])))[2], 3)) for t in texts]
    groups = {1: (0, 1, 3), 2: (0, 2, 3)}

    def signed(k, num, den):
        def run(batches):
            for b in batches:
                own = [ids[texts.index(t)] for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"sig": [g for i in own for g, m in groups.items() if ids.index(i) in m],
                                                  "id": [i for i in own for m in groups.values() if ids.index(i) in m]},
                                                 schema=pa.schema([("sig", pa.int64()), ("id", pa.int64())]))
        return run

    monkeypatch.setattr(J, "_signed", signed)
    got = J.jaccard_components(frame(spark, list(enumerate(texts)) * 2)).collect()
    assert len(got) == 8 and {r.component_id for r in got} == {0}


def test_workers_give_their_memory_back(spark, monkeypatch):
    """At the end of a task, whether it ends well or not; near copies are found in small batches."""
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(1))
    b = pa.RecordBatch.from_pydict({"x": [1]})
    assert list(common.lean(lambda batches: (x for x in batches))(iter([b]))) == [b] and done == [1]
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda batches: (1 // 0 for _ in batches))(iter([b])))
    assert done == [1, 1]
    sizes = []
    label = J.labelled_rows
    monkeypatch.setattr(J, "labelled_rows", lambda *a, **k: (sizes.append(int(spark.conf.get(common._PHASE))), label(*a, **k))[1])
    assert J.keep_one(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f")])).count() == 1
    assert sizes[0] <= 512 << 10


def test_give_back_lowers_a_worker(spark):
    """What one task held is not kept by the worker that waits for the next."""
    def held(batches):
        for b in batches:
            kept = [np.ones(1000) for _ in range(40_000)]
            hole = np.ones(1000)  # above them, so that the heap's end does not fall
            del kept
            yield pa.RecordBatch.from_pydict({"x": [int(hole[0])] * b.num_rows})

    def resident(batches):
        for b in batches:
            pages = int(open("/proc/self/statm").read().split()[1])
            yield pa.RecordBatch.from_pydict({"x": [pages * 4096 >> 20] * b.num_rows})

    one = spark.range(1).coalesce(1)
    common.map_arrow(one, held, "x long").collect()
    assert common.map_arrow(one, resident, "x long").first().x < 300
