import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import suffix_dedup as S


def slow(texts, size=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def texts(seed):
    r = random.Random(seed)
    rand = lambda n, a="abcdefgh é": "".join(r.choices(a, k=n))
    passage, other = rand(400), rand(230)
    out = [rand(r.randint(0, 900)) for _ in range(20)]
    out += [rand(r.randint(0, 300)) + passage + rand(r.randint(0, 300)) for _ in range(12)]
    out += [rand(50) + other + rand(20) + other, passage[:199], passage[:200], passage[100:350], "a" * 199, "a" * 200, "a" * 201, "b" * 900, "ab" * 400, "", None]
    one = rand(1500)
    for _ in range(4):
        i = r.randrange(1400)
        out.append(one[:i] + "XYZ" + one[i + 2 :])
    return [*out, one, one, out[0]]


def check(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, key string").repartition(3)
    found = {r["doc_id"]: tuple(r)[1:5] for r in S.remove_repeats(docs, **more).collect()}
    assert [found[i] for i in range(len(rows))] == slow(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, texts(seed))


def test_hot_triggers_by_windows(spark):
    check(spark, texts(3), cap=2)


def test_a_passage_under_the_length_is_hot_and_meets_nowhere(spark, monkeypatch):
    """Many texts hold one 195-byte passage among random neighbours: no group of over CAP rows meets."""
    r = random.Random(5)
    rand = lambda n: "".join(r.choices("abcdefgh", k=n))
    short, long = rand(195), rand(260)
    rows = [rand(60) + short + rand(60) for _ in range(90)] + [rand(40) + long + rand(40) for _ in range(40)] + [rand(30) + short + "x" * 40] * 2
    check(spark, rows, cap=30)
    data, offsets = np.frombuffer("".join(rows).encode(), np.uint8), np.cumsum([0, *map(len, rows)])
    hot = Counter(int(k) for p in S.pieces(data, offsets) for k in S.triggers(p)[4])
    assert max(hot.values()) > 90


def test_repeated_rows_are_each_their_own(spark):
    text = "".join(random.Random(2).choices("abcdef", k=500))
    docs = spark.createDataFrame([(1, text)] * 30 + [(2, "short")] * 5, "doc_id long, text string").repartition(4)
    found = S.remove_repeats(docs).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in found) == [(1, 500, 1)] * 30 + [(2, 0, 0)] * 5


def test_small_pieces_and_runs(spark, monkeypatch):
    """Long texts in parts, runs flushed early: seen in this process, where the sizes are changed."""
    rows = texts(4)
    data = np.frombuffer("".join(t or "" for t in rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in rows])])
    want = [set() for _ in rows]
    for size in (1 << 20, 300):
        got = [set() for _ in rows]
        for p in S.pieces(data, offsets, size=size):
            text, t, lo, hi, key = S.triggers(p)
            for x, tt, a, b, k in zip(text, t, lo, hi, key):
                at = p.base if len(p.low) == 1 and p.row + x < len(rows) and p.base else p.base - p.offsets[x]
                for w in range(a, b + 1):
                    got[p.row + x].add((w + at, int(k), tt - w))
        if size == 1 << 20:
            want = got
    assert got == want
    assert [len(w) for w in want] == [max(0, len((t or "").encode()) - 199) for t in rows]


def test_kept_bytes_and_names(docs, rows):
    found = S.remove_repeats(docs).collect()
    want = sorted(map(repr, ((i, *x) for (i, *_), x in zip(rows, slow([t for _, t, *_ in rows])))))
    assert sorted(repr(tuple(r)[:5]) for r in found) == want
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in found)


def test_empty(none):
    assert S.remove_repeats(none).count() == 0
