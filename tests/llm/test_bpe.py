import random

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer as Reference

from brute import documents, frame, sha
from ensemble.llm import bpe
from ensemble.llm.queries import vocabulary


@pytest.fixture(scope="module")
def both():
    return bpe.Tokenizer(vocabulary()), Reference.from_file(vocabulary())


def check(both, text):
    own, ref = both
    ids = ref.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == ref.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab theing  \n\t'sre0123٣éß日!*$_-\u200b\U0001F600\u0301\x00\x1c\x85", max_size=60))
def test_same_as_the_library(both, text):
    check(both, text)


def test_special_tokens_and_long_runs(both):
    for text in ["", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "a" * 3000, " " * 3000, "ab" * 2000, "=-" * 1000, "x \n y", " x ", "a \n\n b"]:
        check(both, text)


def test_decode_of_broken_utf8(both):
    own, ref = both
    rnd = random.Random(4)
    for _ in range(50):
        ids = [rnd.randrange(50257) for _ in range(20)]
        assert own.decode(ids) == ref.decode(ids, skip_special_tokens=False)


def test_query_rows(spark, both):
    rows = documents()
    ref = both[1]
    want = []
    for d, t in rows:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    got = bpe.encode_documents(frame(spark, rows), vocabulary(), keep_ids=True)
    key = lambda x: (x[0] is not None, x[0] or 0, x[2])
    assert sorted([tuple(r)[:4] for r in got.collect()], key=key) == sorted(want, key=key)
    back = sorted([(r.doc_id is not None, r.doc_id or 0, r.text) for r in bpe.decode_documents(got, vocabulary()).collect()])
    assert back == sorted((d is not None, d or 0, t or "") for d, t in rows)
    assert bpe.encode_documents(frame(spark, []), vocabulary()).collect() == []
