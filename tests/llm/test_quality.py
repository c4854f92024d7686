import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from quern.llm import quality
from quern.llm.common import text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), len(lines), text.count("|"), text.count("!"),
        len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text)), sum(len(x.encode()) > 100 for x in w),
    )


def measure(texts):
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(texts, pa.string()))
    return list(zip(*(x.tolist() for x in quality.measure_block(data, offsets))))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x85|#!é中A", max_size=60)), max_size=8))
def test_measures(texts):
    assert measure(texts) == [slow(t) for t in texts]


def test_docs(docs, rows):
    found = quality.ledger(docs).collect()
    assert sorted(map(repr, ((r["doc_id"], *(r[m] for m in quality.MEASURES)) for r in found))) == sorted(map(repr, ((i, *slow(t)) for i, t, *_ in rows)))


def test_policies_and_ablations(spark):
    texts = ["good words stand here in a row of more than ten words", "few words", "a a a a a a a a a a a a", "x! y! z! " * 5 + " ".join(map(str, range(40))), None]
    rows = quality.apply_policy(quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "web-1")
    kept = {r["doc_id"]: r["kept"] for r in rows.collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: False}
    got = {r["rule"]: r for r in quality.ablations(rows, "web-1").collect()}
    bits = [r["fail_bits"] for r in rows.collect()]
    mask = quality.POLICIES["web-1"]
    for name, r in got.items():
        b = quality.BIT[name]
        assert r["rows"] == 5 and r["dropped"] == sum(x & mask != 0 for x in bits) and r["fails"] == sum(x & b != 0 for x in bits)
        assert r["alone"] == sum(x & mask == b for x in bits) and r["dropped_without"] == sum(x & mask & ~b != 0 for x in bits)
    assert set(got) == {n for n, _ in quality.RULES if quality.BIT[n] & mask}
    with pytest.raises(KeyError):
        quality.apply_policy(rows, "web-0")


def test_long_text():
    text = ("lorem ipsum " * 3 + "x" * 500 + "\n") * 5000
    assert measure([text]) == [slow(text)]


def test_empty(none):
    assert quality.ledger(none).count() == 0


