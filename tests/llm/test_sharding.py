import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ensemble.llm import sharding as S
from ensemble.llm.common import table
from conftest import SF_SMALL

SCHEMA = "doc_id long, text string, shard int, n long, salt int, hub0 string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 3, 4, 5, "h") for d, t in rows], SCHEMA)


def checked(rows, got, shards=8):
    """Splits of the groups of equal texts, after everything that must hold does."""
    load = Counter(r.shard for r in got)
    assert len(got) == len(rows) and {r.law for r in got} <= {"rows"} and all(r.grown_shard is None for r in got)
    assert all(load.get(s, 0) in (len(rows) // shards, -(-len(rows) // shards)) for s in range(shards))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    form = lambda d, t: (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter(form(d, t) for d, t in rows) == Counter((str(r.doc_id), r.size, r.text_crc32) for r in got)
    groups = defaultdict(Counter)
    for r in got:
        if r.size > 1:
            groups[r.size, r.text_crc32][r.shard] += 1
    return [g for g in groups.values() if sum(g.values()) > 1]


def test_whole_table_keeps_groups_together(spark):
    docs = table(spark, SF_SMALL, "documents")
    groups = checked([(r.doc_id, r.text) for r in docs.collect()], S.shard_documents(docs).collect())
    assert groups and all(len(g) == 1 for g in groups)


def test_hot_group_and_pairs(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i // 6}") for i in range(2400)]
    groups = checked(rows, S.shard_documents(frame(spark, rows)).collect())
    hot = max(groups, key=lambda g: sum(g.values()))
    assert sum(hot.values()) == 800 and sum(sorted(hot.values())[-3:]) >= 760  # three shards are the fewest
    others = [g for g in groups if g is not hot]
    assert sum(len(g) > 1 for g in others) <= 0.25 * len(others)


def test_all_documents_linked(spark):
    """No free rows to even things out with: at most the shards' borders cut groups, a random deal would cut nearly all."""
    rows = [(i, f"t{i // 2}") for i in range(2001)]
    groups = checked(rows, S.shard_documents(frame(spark, rows)).collect())
    assert sum(len(g) > 1 for g in groups) <= 0.05 * len(groups)


def test_several_kinds_of_links(spark):
    rows = [(i, f"t{i}") for i in range(800)]
    docs = frame(spark, rows)
    got = S.shard_documents(docs, shards=4, links=[F.floor(F.col("doc_id") / 4), F.floor((F.col("doc_id") + 2) / 4)], rounds=12).collect()
    checked(rows, got, 4)
    where = {r.doc_id: r.shard for r in got}
    cut = sum(where[i] != where[i + 1] for i in range(799))
    assert cut < 0.5 * 800  # three quarters in a random deal


def test_awkward_rows(spark):
    rows = [(None, None), (None, "a"), (1, ""), (1, "a"), (1, "a"), (2, None), (3, "x" * 200_000), (3, "é")]
    checked(rows, S.shard_documents(frame(spark, rows)).collect())
    checked(rows[:3], S.shard_documents(frame(spark, rows[:3])).collect())
    empties = [(i, None) for i in range(100)] + [(7, "b")] * 40
    checked(empties, S.shard_documents(frame(spark, empties)).collect())
    assert S.shard_documents(frame(spark, [])).collect() == []


@pytest.mark.parametrize("wanted,load,quota,upto,turned", [
    ({(0, 1, 0): 5, (0, 1, 3): 5}, [10, 5], [10, 10], {(0, 1): 0}, {1}),  # the second step does not fit
    ({(0, 1, 0): 5, (1, 0, 0): 5}, [10, 10], [10, 10], {(0, 1): 0, (1, 0): 0}, set()),  # a swap fits full shards
    ({(0, 1, 0): 5, (1, 0, 2): 3}, [10, 10], [10, 10], {}, {0, 1}),
])
def test_moves_stay_within_quotas(wanted, load, quota, upto, turned):
    assert S.accepted(wanted, load, quota) == (upto, turned)


def test_no_python_in_the_plan(spark):
    plan = S.shard_documents(table(spark, SF_SMALL, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
