import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import exact_dedup


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_against_brute_force(docs, rows, keep):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    want = []
    for i, t, *_ in rows:
        known = [x for x in groups[t or ""] if x is not None]
        best = pick(known) if known else None
        want.append((i, best, len(groups[t or ""]), best is None or i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, exact_dedup.exact_dedup(docs, keep=keep).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("fan, parts, chunk", [(2, 9, 3), (3, 9, 1), (8, 3, 20_000)])
def test_many_rounds(docs, rows, monkeypatch, fan, parts, chunk):
    """Four, two and one levels of the tree, in the operator itself, against brute force."""
    monkeypatch.setattr(exact_dedup, "FAN", fan)
    monkeypatch.setattr(exact_dedup, "CHUNK", chunk)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    measured = exact_dedup.digests(docs.repartition(parts))
    assert measured.rdd.getNumPartitions() == parts
    want = sorted((hashlib.sha256(t.encode()).digest(), min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items())
    found = exact_dedup.merge_tree(measured, shards=3).collect()
    assert sorted((bytes(r["digest"]), r["best"], r["n_rows"]) for r in found) == want


@pytest.mark.parametrize("largest", [True, False])
def test_merge_of_runs_by_heads(largest, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CHUNK", 5)
    r = random.Random(3)
    want, chunks = {}, []
    for run in range(6):
        made = {f"{r.randrange(60):048d}".encode(): (r.randrange(1000), r.random() < 0.8, r.randint(1, 3)) for _ in range(40)}
        keys = sorted(made)
        e = exact_dedup.Entries(np.array(keys, "S48"), *(np.array(x) for x in zip(*(made[k] for k in keys))))
        chunks += e.rows(0, run % 2)
        for k, (best, known, n) in made.items():
            ids, total = want.setdefault((run % 2, k), ([], [0]))
            ids += [best] * known
            total[0] += n
    chunks.sort(key=lambda c: (c["shard"], c["head"]))
    got, before = {}, (-1, b"")
    for _, shard, e in exact_dedup.merge(iter(chunks), largest):
        for k, best, known, n in zip(e.keys.tolist(), e.best.tolist(), e.known.tolist(), e.n_rows.tolist()):
            assert before < (shard, k)
            before = (shard, k)
            got[before] = (best if known else None, n)
    assert got == {k: ((max if largest else min)(ids) if ids else None, total[0]) for k, (ids, total) in want.items()}


def test_unlike_checks_stay_apart(spark):
    rows = spark.createDataFrame([(1, b"d", 3, 7), (2, b"d", 3, 8), (3, b"d", 4, 7), (4, b"d", 3, 7)], "doc_id long, digest binary, n_bytes long, check long").selectExpr("doc_id", "concat(digest, digest, digest, digest) AS digest", "n_bytes", "check")
    found = exact_dedup.merge_tree(rows).collect()
    assert sorted((r["best"], r["n_rows"]) for r in found) == [(1, 2), (2, 1), (3, 1)]


def test_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0
