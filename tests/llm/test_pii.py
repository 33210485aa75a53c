import random

from brute import base_spans, documents, frame, sha
from ensemble.llm import pii


def check(got, rows):
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    for d, t in rows:
        spans = base_spans(t)
        text = ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
        match = [r for r in by[d] if r.base_sha256 == sha(text) and r.spans.startswith(text)]
        assert match, (d, t)
        r = match[0]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in pii.KINDS[:4]]
        assert len(r.spans.split(",")) == len(spans) + r.n_secret or not r.spans


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aB1 2-3.4@+5()_%é\U0001F600\n") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["9" * 20_000, "9 " * 15_000, "a" * 30_000, "a@b.c_" * 500, "+1" + " " * 20_000, "1.2.3.4." * 500, "a." * 9000 + "@",
              "4111 1111 1111 1111", "+1 (305) 555-0100 x", "1.2.3.256 001.02.3.4", "a@b.c_d@e.f", "é😀 me@x.org", None, ""]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, "a@b.cd")]
    check(pii.find_personal_data(frame(spark, rows)).collect(), rows)


def test_secrets_are_added(spark):
    rnd = random.Random(4)
    token = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'some words {i} token = "{token()}" and more') for i in range(30)]
    rows += [(100 + i, f"see chapter_of_part{i} or version-{i}-draft of it, call +1 (305) 555-01{i:02d} now") for i in range(30)]
    rows += [(200 + d, t) for d, t in documents(10) if d is not None]
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    assert all(got[i].n_secret == 1 for i in range(30)) and not any(got[100 + i].n_secret for i in range(30))
    start, end = got[3].spans.split(":")[1:]
    assert rows[3][1][int(start) : int(end)] == rows[3][1].split('"')[1]


def test_reliabilities_follow_the_good_labelers():
    rnd = random.Random(5)
    counts, truths = {}, {}
    for _ in range(4000):
        y = rnd.random() < 0.3
        v = tuple((1 if (rnd.random() < p) == y else -1) for p in (0.95, 0.9, 0.9, 0.6, 0.5))
        counts[v] = counts.get(v, 0) + 1
        truths.setdefault(v, []).append(y)
    post = pii.reliabilities(counts)
    wrong = sum((post[v] >= 0.5) != y for v, ys in truths.items() for y in ys)
    assert wrong / 4000 < 0.06


def test_empty_table_and_plan(spark):
    docs = frame(spark, [])
    assert pii.find_personal_data(docs).collect() == []
    plan = pii.candidates(frame(spark, documents(3)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
