import corpus_pipeline as P
from brute import components, frame, removed_lines, words
from conftest import SF_SMALL
from ensemble.llm import decontaminate, quality
from ensemble.llm.common import table


def test_stages_and_effects(spark):
    """Each stage on its predecessor's rows: columns stay, decisions equal those of the operators in plain Python."""
    docs = table(spark, SF_SMALL, "documents")
    names = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_copies", "decontaminate", "bpe"] and P.ORACLE_SQL is None
    kept = P.keep_quality(spark, docs, SF_SMALL).cache()
    labels = {r.doc_id: r.quality for r in table(spark, SF_SMALL, "labels").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == names and sum((labels[d] == 1) == (d in ids) for d in labels) >= 0.9 * len(labels)

    lines = P.drop_repeated_lines(spark, kept, SF_SMALL).cache()
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    gone = removed_lines(rows)
    want = {}
    for d, t in rows:
        left = [x for i, x in enumerate(t.split("\n")) if i not in gone[d, t]]
        if not gone[d, t] or any(words(x) for x in left):
            want[d] = "\n".join(left)
    assert lines.columns == names and {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    one = P.keep_one_of_near_copies(spark, kept, SF_SMALL).cache()  # on the rows that still have copies
    group, _ = components(rows, 5, 80, 100)
    assert one.columns == names and {r.doc_id for r in one.collect()} == {d for (d, _), c in zip(rows, group) if d == c}

    clean = P.drop_benchmark_leaks(spark, one, SF_SMALL)
    leaks = {r.doc_id for r in decontaminate.find_contamination(one, table(spark, SF_SMALL, "benchmark")).collect()}
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaks


def test_run_and_empty_documents(spark):
    out = P.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= 200
    empty = frame(spark, [])
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0
    odd = frame(spark, [(1, None), (2, ""), (2, ""), (None, "null id and some words"), (3, "x" * 100_000)])
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, odd, SF_SMALL)
        assert got.columns == odd.columns and got.count() <= 5
