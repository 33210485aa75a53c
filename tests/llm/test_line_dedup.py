import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from brute import documents, frame, removed_lines, words
from ensemble.llm import line_dedup as L, similar as S


def rows_with_lines():
    rows = documents(20)
    lines = [t for _, t in rows[:8]]
    more = ["\n".join(lines[i % 8] + (" tail" if i % 3 else "") for i in range(j, j + 4)) for j in range(6)]
    hot = [f"common line of many documents here\nown {i} " + " ".join(f"w{i}x{j}" for j in range(12)) for i in range(40)]
    family = ["head\n" + " ".join(f"f{j}" if (i * 7 + j) % 29 else f"f{j}e{i}" for j in range(60)) for i in range(30)]
    return rows + [(500 + i, t) for i, t in enumerate(more + hot + family)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("small,chunk", [(16, 4 << 20), (2, 2000)])
def test_removed_lines_equal_brute_force(spark, monkeypatch, small, chunk):
    monkeypatch.setattr(L, "SMALL_GROUP", small)
    monkeypatch.setattr(L, "CHUNK_BYTES", chunk)
    rows = [r for r in rows_with_lines() if r[0] is not None]
    want = removed_lines(ordered(rows))
    got = L.removed_lines(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in got) == sorted(
        (d, sum(bool(words(x)) for x in (t or "").split("\n")), len(want[d, t]), ",".join(map(str, want[d, t]))) for d, t in rows)


def test_documents_without_the_lines(spark):
    rows = rows_with_lines()
    docs = frame(spark, rows)
    got = L.dedup_lines(docs)
    assert got.columns == docs.columns
    kept = {}
    for r in got.collect():
        kept.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars == len(r.text or "")
    want = removed_lines(ordered([r for r in rows if r[0] is not None]))
    for d, t in rows[:40]:
        if d is None or any(t and t == u for e, u in rows if e is None):
            continue
        lines = (t or "").split("\n")
        left = [x for i, x in enumerate(lines) if i not in want[d, t]]
        if want[d, t] and not any(words(x) for x in left):
            assert d not in kept
        else:
            assert set(kept[d]) == ({"\n".join(left)} if want[d, t] else {t})
    assert L.dedup_lines(frame(spark, [])).collect() == []
    assert L.removed_lines(frame(spark, [])).collect() == []


def test_prefixes_need_no_import_of_another_module():
    code = ("import numpy as np, pyarrow as pa\n"
            "from ensemble.llm.line_dedup import _prefixes\n"
            "b = pa.RecordBatch.from_pydict({'id': pa.array([7], pa.int64()), 'size': pa.array([3], pa.int32()),\n"
            "                                'prefix': pa.array([np.array([5, 6], np.int64).tobytes()], pa.binary())})\n"
            "print([r['tok'] for x in _prefixes(iter([b])) for r in x.to_pylist()])\n")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "[5, 6]", out.stderr


def test_dealt_tokens_give_those_of_several_sets(monkeypatch):
    monkeypatch.setattr(L, "DEAL_BYTES", 64)
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 60, rng.integers(0, 6)) for _ in range(80)] + [np.array([7])] * 200  # token 7 is in most of them
    batch = pa.RecordBatch.from_pydict({"id": pa.array(np.arange(len(sets)) - 40, pa.int64()),
                                        "prefix": pa.array([x.astype(np.int64).tobytes() for x in sets], pa.binary())})
    runs_ = [b for i in range(0, len(sets), 9) for b in L._dealt(5)(iter([batch.slice(i, 9)]))]
    assert max(sum(e == 7 for e, _ in np.frombuffer(d, np.int64).reshape(-1, 2)) for b in runs_ for d in b.column("data").to_pylist()) <= 2
    dealt = pa.Table.from_batches(runs_).sort_by("bucket").to_batches()
    got = [x for b in L._shared(iter(dealt)) for x in b.column("tok").to_pylist()]
    holders = {}
    for i, s in enumerate(sets):
        for x in s.tolist():
            holders.setdefault(x, set()).add(i)
    assert sorted(got) == sorted(x for x, who in holders.items() if len(who) > 1)
    assert not list(L._shared(iter([])))
