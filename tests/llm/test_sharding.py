import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.llm import sharding


def slow_best_fit(sizes, capacity, bins=None):
    left, where = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(c, b) for b, c in enumerate(left) if c >= sizes[i]]
        if not fits:
            if bins is not None and (len(left) == bins or sizes[i] > capacity):
                return None
            left.append(max(capacity, sizes[i]))
            fits = [(left[-1], len(left) - 1)]
        b = min(fits)[1]
        where[i] = b
        left[b] -= sizes[i]
    return where


@given(st.lists(st.integers(1, 50), max_size=60), st.integers(20, 90), st.sampled_from([None, 3, 10]))
def test_packing_is_best_fit_decreasing(sizes, capacity, bins):
    assert sharding.best_fit_decreasing(sizes, capacity, bins) == slow_best_fit(sizes, capacity, bins)


def test_tree_stays_in_order():
    tree, plain, r = sharding.Treap(), [], random.Random(4)
    for _ in range(2000):
        if r.random() < 0.6:
            key = (r.randrange(500), r.randrange(10**6))
            tree.insert(key)
            plain.append(key)
        else:
            bound = (r.randrange(500), -1)
            want = min((k for k in plain if k >= bound), default=None)
            assert tree.take(bound) == want
            if want:
                plain.remove(want)


def check(found, rows, shards):
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in found) == sorted(
        (i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    by_text = defaultdict(set)
    for r in found:
        by_text[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}


def test_shards(docs, rows):
    check(sharding.pack_shards(docs, 5).collect(), rows, 5)


def test_more_shards_than_groups(docs, rows):
    check(sharding.pack_shards(docs, 400).collect(), rows, 400)


def by_hand(rows, capacity=None, shards=None):
    """Shard of each text: best-fit decreasing of all groups, one by one; of equal sizes the least digest first."""
    size = defaultdict(int)
    for _, t, *_ in rows:
        size[t or ""] += len((t or "").encode()) + 16
    groups = sorted(size, key=lambda t: (-size[t], hashlib.sha256(t.encode()).digest()))
    sizes = [size[t] for t in groups]
    if capacity is None:
        capacity = max(max(sizes), -(-sum(sizes) // shards))
        while slow_best_fit(sizes, capacity, shards) is None:
            capacity += 1
    return dict(zip(groups, slow_best_fit(sizes, capacity, shards)))


@pytest.mark.parametrize("shards, capacity", [(5, None), (None, 9_000)])
def test_placement_of_the_query_is_best_fit_decreasing(spark, shards, capacity):
    """Many groups of one size, and one text that a third of all rows have."""
    r = random.Random(8)
    texts = ["".join(r.choices("abc", k=r.choice([10, 10, 10, 50, 51, 200, r.randint(1, 300)]))) for _ in range(300)] + ["hot" * 30] * 150
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sharding.pack_shards(docs, shards, capacity).collect()
    want = by_hand(rows, capacity, shards)
    where = {r["doc_id"]: r["shard"] for r in found}
    assert where == {i: want[t] for i, t in rows}
    check(found, rows, max(want.values()) + 1)


def test_a_row_repeated_often_is_numbered_in_parts(spark):
    rows = [(1, "same")] * 500 + [(i, f"t{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(sharding.pack_shards(docs, 3).collect(), rows, 3)


def test_sizes_are_near_equal(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, "x" * r.randint(1, 400) + str(i)) for i in range(800)], "doc_id long, text string")
    total = [0] * 8
    for x in sharding.pack_shards(docs, 8).collect():
        total[x["shard"]] += x["size"]
    assert max(total) - min(total) < 0.01 * sum(total) / 8


def test_fixed_capacity(docs, rows):
    found = sharding.pack_shards(docs, None, capacity=60_000).collect()
    size = defaultdict(int)
    for r in found:
        size[r["shard"]] += r["size"]
    assert len(found) == len(rows) and max(size.values()) <= 60_000
    assert len(size) <= -(-sum(size.values()) // 60_000) + 1


def test_empty(none):
    assert sharding.pack_shards(none, 4).count() == 0
