import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(bpe.default_path())


PARTS = [*"aaab b  \t\n\x0b\x1c\x1d\x85\xa0\u2028\u3000'sre'll0\u0663\u00bd\xe9\xc9\xdf\u4e2d\u6587\U0001f600\u0301\u200b\x00.,!<|>", "<|endoftext|>", "   ", "aaaa", "the", " of"]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(PARTS), max_size=40).map("".join)))
def test_as_the_library(library, vocab, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert vocab.encode(text) == want
    assert vocab.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_runs(library, vocab):
    for text in ("a" * 5001, " " * 3000, "ab" * 3000, "=" * 777, "aaab" * 999):
        assert vocab.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_any_ids(library, vocab):
    r = random.Random(1)
    for _ in range(50):
        ids = [r.randrange(50257) for _ in range(20)]
        assert vocab.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_forgetting(vocab, library):
    codec = bpe.Codec(vocab, memory=20)
    r = random.Random(3)
    for _ in range(5):
        texts = ["".join(r.choices(PARTS, k=30)) for _ in range(10)]
        for (decimal, raw, packed), t in zip(codec.encode(texts), texts):
            want = library.encode(t, add_special_tokens=False).ids
            assert decimal == ",".join(map(str, want)) and np.frombuffer(packed, np.int32).tolist() == want and raw.decode() == t


def test_docs(docs, rows, library):
    found = bpe.encode_docs(docs)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    back = {r["doc_id"]: r["text"] for r in bpe.decode_docs(found).collect() if r["doc_id"] is not None}
    assert back == {i: t or "" for i, t, *_ in rows if i is not None}


def test_empty(none):
    assert bpe.encode_docs(none).count() == 0
