import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import toxicity as T

BAD = ("grumpf", "snarkle", "zorgo")


def corpus(n, seed=1):
    """Toxic texts have two bad words, or words with a bad stem; one in four texts is toxic."""
    r = random.Random(seed)
    common = ["".join(r.choices("aeioulmnrst", k=r.randint(2, 6))) for _ in range(400)]
    out = []
    for i in range(n):
        toxic = int(r.random() < 0.25)
        w = r.choices(common, k=r.randint(5, 200))
        for _ in range(2 * toxic):
            w[r.randrange(len(w))] = r.choice(BAD) if r.random() < 0.7 else "vexu" + "".join(r.choices("aeioul", k=3))
        out.append((i, " ".join(w).capitalize() + ".", toxic))
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus(700)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (9003, "...", "x"), (None, rows[0][1], "y"), (0, rows[0][1], "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(9001, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, T.toxicity(docs, labels).collect()


def test_held_out_accuracy(found):
    rows, out = found
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert 150 < len(held)
    wrong = [r for r in held if r["predicted"] != truth[r["doc_id"]]]
    assert len(wrong) <= 0.05 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out if r["doc_id"] is not None)


def test_edge_cases(found):
    rows, out = found
    assert len(out) == len(rows) + 5
    by = {r["doc_id"]: r for r in out}
    assert by[9001]["score"] == by[9002]["score"] == by[9003]["score"] == 0 and by[9001]["predicted"] == 0
    assert not by[None]["held_out"] and by[None]["score"] == pytest.approx(by[0]["score"], abs=1e-5)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)


def test_all_windows_are_scored():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 500):
        text, at, size = T.windows(np.array([0, n, n + 5]))
        seen = set()
        for a, k in zip(at[text == 0], size[text == 0]):
            seen |= set(range(a, a + k))
        assert seen == set(range(n)) and (size[text == 1] == 5).all()


def test_one_bad_place_in_a_long_text():
    rows = corpus(400, seed=2)
    model = T.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    r = random.Random(4)
    clean = [t for _, t, y in rows if not y]
    long = " ".join(clean[:40])
    cut = len(long) // 2
    bad = long[:cut] + f" {BAD[0]} {BAD[1]} " + long[cut:]
    s = T.score_texts(model, pa.array([long, bad, None, "x"]))
    assert s[1] >= 0.7 > s[0] and s[2] == 0 and 0 <= s[3] <= 1
    assert r is not None


def test_gradient():
    """Backward against differences of the loss."""
    rows = corpus(60, seed=3)
    table = T.LogOdds(np.array([1, 2], np.uint64), np.array([1, 0]), np.array([0, 1]), 1, 1)
    model = T.Model(table, table)
    f, ids, grid, text, n = T._prepare(model, pa.array([t for _, t, _ in rows[:12]]))
    u, mask = model.p["uf"], np.arange(T.WINDOW)[:, None] < n
    x = np.random.default_rng(1).normal(size=(T.WINDOW, len(n), 3 * T.HIDDEN)).astype(np.float32)
    keep = []
    out = T.gru(x, u, mask, keep)
    d_in, d_u = T.gru_back(np.ones_like(out), u, mask, keep)
    step = np.zeros_like(u)
    step[2, 5] = 1e-2
    numeric = (T.gru(x, u + step, mask).sum() - T.gru(x, u - step, mask).sum()) / 2e-2
    assert numeric == pytest.approx(d_u[2, 5], rel=0.05, abs=0.05)
    step = np.zeros_like(x)
    step[3, 1, 4] = 1e-2
    numeric = (T.gru(x + step, u, mask).sum() - T.gru(x - step, u, mask).sum()) / 2e-2
    assert numeric == pytest.approx(d_in[3, 1, 4], rel=0.05, abs=0.02)


def test_labels_of_one_class(spark, docs):
    some = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    assert {r["score"] for r in T.toxicity(docs, some).collect()} == {0.0}
    assert {r["predicted"] for r in T.toxicity(docs, some.limit(0)).collect()} == {0}


def test_empty(spark, none):
    assert T.toxicity(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_counts():
    c = T.Counts()
    c.add([np.array([1, 5], np.uint64), np.array([5], np.uint64)], np.array([1, 0]))
    c.add([np.array([5, 9], np.uint64), np.array([1], np.uint64)], np.array([1, 1]))
    keys, toxic, clean = c.repeated()
    assert keys.tolist() == [1, 5] and toxic.tolist() == [2, 2] and clean.tolist() == [0, 1]


def test_fitted_on_a_bounded_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "fit", lambda texts, toxic: seen.append((len(texts), sum(map(len, texts)))) or 0.0)
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    T.fit_labels(docs, labels, most=20)
    T.fit_labels(docs, labels, most_bytes=1050)
    assert seen == [(40, 4000), (20, 2000)]


def test_long_texts_starve_no_others(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "fit", lambda texts, toxic: seen.append(sorted((y, len(t)) for t, y in zip(texts, toxic))) or 0.0)
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    learned = [r["doc_id"] for r in labels.filter(~T.held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.lit(3), "doc_id")).collect()]
    of = {k: [i for i in learned if i % 2 == k] for k in (0, 1)}

    def fitted(long, most_bytes):
        docs = spark.createDataFrame([(i, "x" * long.get(i, 10)) for i in range(600)], "doc_id long, text string")
        T.fit_labels(docs, labels, most=100, most_bytes=most_bytes)
        return seen.pop()

    whole = [(k, 10) for k in (0, 1) for _ in range(99)]
    # The first text of each class is too long, or takes nearly all bytes.
    for size in (5000, 1900):
        assert fitted({of[0][0]: size, of[1][0]: size}, 2000) == whole
    # Several that would fill the bytes together; those that fit beside the others are learned from.
    found = fitted({i: 300 for k in of for i in of[k][:20]}, 2000)
    assert found == sorted((k, n) for k in (0, 1) for n in [10] * 80 + [300] * 4)
    # Each class has some rows however long its texts are.
    found = fitted({i: 5000 for i in of[1]}, 2000)
    assert found == [(0, 10)] * 100 + [(1, 5000)] * T.LEAST_ROWS


def test_memory_of_the_fit_is_given_back(spark, monkeypatch):
    """The driver goes on to other stages with what it has."""
    done = []
    monkeypatch.setattr(T, "fit", lambda texts, toxic: done.append("fit") or 0.0)
    monkeypatch.setattr(T, "release", lambda: done.append("release"))
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(6)], "doc_id long, text string")
    T.fit_labels(docs, spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int"))
    assert done == ["fit", "release"]
