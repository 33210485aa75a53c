import random

import pyarrow as pa

from brute import frame
from ensemble.llm import decontaminate as D


def items_and_docs():
    rnd = random.Random(8)
    vocab = ["the", "of", "and"] * 40 + ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    sentence = lambda n: " ".join(rnd.choice(vocab) for _ in range(n)).capitalize() + ". "
    items = [(i, "".join(sentence(rnd.randint(4, 30)) for _ in range(rnd.randint(1, 5)))) for i in range(60)]
    docs, leaks = [], set()
    for d in range(150):
        text = "".join(sentence(rnd.randint(3, 40)) for _ in range(rnd.randint(1, 20)))
        if d % 5 == 0:
            i = rnd.randrange(60)
            text = text[: len(text) // 2] + " " + (items[i][1].upper() if d % 10 else items[i][1]) + " " + text[len(text) // 2 :]
            leaks.add((d, i))
        docs.append((d, text))
    return items, docs, leaks


def tables(spark, items, docs):
    return (spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"), frame(spark, docs))


def test_leaks_are_found_and_dropped(spark, monkeypatch):
    items, docs, leaks = items_and_docs()
    items += [(70, None), (71, ""), (72, "!!!"), (None, items[0][1])]
    docs += [(900, None), (901, ""), (902, "one"), (903, docs[0][1]), (903, docs[0][1])]
    i, d = tables(spark, items, docs)
    want = leaks | {(903, x) for e, x in leaks if e == 0}
    for shard in (8 << 20, 3000):
        monkeypatch.setattr(D, "SHARD_BYTES", shard)
        got = D.find_contamination(d, i).collect()
        assert {(r.doc_id, r.item_id) for r in got if r.item_id is not None} == want
    kept = D.drop_contaminated(d, i)
    assert kept.columns == d.columns
    dirty = {x for x, _ in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x for x, _ in docs if x not in dirty)


def test_retrieval_equals_full_scoring(spark, monkeypatch):
    """Every window's entries at the threshold or above, with and without the bounds."""
    items, docs, _ = items_and_docs()
    i, _ = tables(spark, items, docs)
    (index,) = D.build(i, 0.35)
    found = full = 0
    for _, _, h, off in D.W.batch_words(pa.array([t for _, t in docs]), D.W.PLAIN):
        t = index.look_up(h)
        seen = set(zip(*(x.tolist() for x in index.windows(t, off))))
        for doc in range(len(off) - 1):
            for first in range(int(off[doc]), max(int(off[doc]) + 1, int(off[doc + 1]) - D.ENTRY), D.ENTRY):
                end = min(first + 2 * D.ENTRY, int(off[doc + 1]))
                terms = {x for x in t[first:end].tolist() if x >= 0}
                score = {}
                for x in terms:
                    for p in range(index.start[x], index.start[x + 1]):
                        score[index.entry[p]] = score.get(index.entry[p], 0) + index.weight[p]
                want = {e for e, s in score.items() if s >= 0.35}
                full += len(want)
                got = set(index.retrieve(t[first:end])[0].tolist())
                assert got == want and (not want or (doc, first, end) in seen)
                found += len(got)
    assert found == full > 30


def test_empty_tables(spark):
    items, docs, _ = items_and_docs()
    i, d = tables(spark, items, docs)
    none_i, none_d = tables(spark, [], [])
    assert D.find_contamination(d, none_i).collect() == [] and D.find_contamination(none_d, i).collect() == []
    assert D.drop_contaminated(d, none_i).count() == len(docs)
