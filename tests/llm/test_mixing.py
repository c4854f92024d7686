import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.llm import mixing


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    target = mixing.water_fill(sizes, weights, 1.5, 2.0)
    assert sum(target) == pytest.approx(1.5 * sum(sizes))
    assert all(t <= 2 * s + 1e-9 for t, s in zip(target, sizes))
    free = {round(t / w, 6) for t, w, s in zip(target, weights, sizes) if t < 2 * s - 1e-6}
    assert len(free) <= 1


@given(st.lists(st.integers(0, 300), min_size=1, max_size=200), st.floats(0.05, 0.95), st.integers(0, 5))
def test_flight_keeps_the_sums(sizes, p, seed):
    moved = mixing.flight([p] * len(sizes), list(map(float, sizes)), random.Random(seed))
    assert sum(0 < x < 1 for x in moved) <= 2
    assert all(0 <= x <= 1 for x in moved)
    assert sum(moved) == pytest.approx(p * len(sizes), abs=1e-5)
    assert sum(x * s for x, s in zip(moved, sizes)) == pytest.approx(p * sum(sizes), rel=1e-6, abs=1e-4)
    assert set(mixing.landing(moved, sizes)) <= {0.0, 1.0}


def test_inclusion_probabilities():
    """Each document is taken as often as it should, over many seeds."""
    sizes = [1.0, 5.0, 20.0, 3.0, 7.0, 7.0, 2.0, 40.0]
    seen = [0.0] * 8
    for seed in range(1500):
        for i, x in enumerate(mixing.flight([0.3] * 8, sizes, random.Random(seed))):
            seen[i] += x
    assert all(abs(s / 1500 - 0.3) < 0.05 for s in seen)


def check(found, rows):
    want = sorted((-1 if i is None else i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s, *_ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["source"]) for r in found) == want or sorted(
        map(repr, ((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["source"]) for r in found))
    ) == sorted(map(repr, want))
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in found)


def slow_targets(rows):
    size = {}
    for _, t, s, *_ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    left, target, open_ = 1.5 * sum(size.values()), {}, list(enumerate(names))
    while open_:
        unit = left / sum((3, 1, 2)[i % 3] for i, _ in open_)
        over = [(i, s) for i, s in open_ if unit * (3, 1, 2)[i % 3] > 2 * size[s]]
        if not over:
            target |= {s: unit * (3, 1, 2)[i % 3] for i, s in open_}
            break
        for i, s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove((i, s))
    return size, target


def test_mix(docs, rows):
    found = mixing.mix_sources(docs).collect()
    check(found, [(i, t, s) for i, t, s, *_ in rows])
    size, target = slow_targets(rows)
    taken = {}
    for r in found:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    longest = {}
    for _, t, s, *_ in rows:
        longest[s] = max(longest.get(s, 0), len((t or "").split()))
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in size)


def test_reruns_agree(docs):
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(mixing.mix_sources(docs)) == key(mixing.mix_sources(docs.repartition(7)))


def test_many_sources(spark):
    r = random.Random(7)
    rows = [(i, "w " * r.randint(0, 30), None if i % 13 == 0 else f"s{r.randint(0, 40)}é") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = mixing.materialize(mixing.sizes_of(docs), "sizes")
    (few, is_few), (many, is_many) = mixing.targets(sizes), mixing.targets(sizes, local=5)
    assert is_few and not is_many
    few, many = ({r["source"]: r["target"] for r in t.collect()} for t in (few, many))
    assert few.keys() == many.keys() and all(many[s] == pytest.approx(few[s]) for s in few)
    found = mixing.balanced_copies(sizes, *mixing.targets(sizes, local=5)).collect()
    assert len(found) == 600 and {r["source"] for r in found} == few.keys()


def test_a_row_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ALIKE", 40)
    rows = [(1, "w " * 7, "a")] * 300 + [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(2, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix_sources(docs, chunk=50).collect()
    check(found, rows)
    own = [r for r in found if r["doc_id"] == 1]
    assert abs(sum(r["copies"] for r in own) - 300 * own[0]["target"] / own[0]["source_size"]) <= 1


def test_rounds_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 3)
    r = random.Random(5)
    docs = spark.createDataFrame([(i, "w " * r.randint(1, 30), "ab"[i % 3 == 0]) for i in range(900)], "doc_id long, text string, source string")
    found = mixing.mix_sources(docs, chunk=20).collect()
    assert len(found) == 900
    for s in "ab":
        part = [x for x in found if x["source"] == s]
        assert abs(sum(x["taken"] for x in part) - part[0]["target"]) <= 60
        expected = part[0]["target"] / part[0]["source_size"] * len(part)
        assert abs(sum(x["copies"] for x in part) - expected) <= 3


def test_empty(none):
    assert mixing.mix_sources(none).count() == 0
