import random

import pytest


from quern.operators import postings as P
from quern.operators import retrieval as R
from quern.operators.fuzzy import similar_terms
from quern.operators.ids import dense_ids
from quern.plans.index import Index

MINI = [(1, "Rust, the rust engine!"), (2, "An engine for index"), (3, "Index merge: index search engine"), (4, "Don't the café"), (5, "fast-path (search)")]


@pytest.fixture(scope="module")
def mini(spark, tmp_path_factory):
    return Index.build(spark, spark.createDataFrame(MINI, "doc_id long, text string"), f"file://{tmp_path_factory.mktemp('mini')}/index")


def ask(index, text, mode="ms", **more):
    return [(r["ext_id"], round(r["score"], 6)) for r in index.search(text, mode=mode, **more).collect()]


def test_scores(mini):
    assert ask(mini, "rust index") == [(1, 1.165035), (3, 0.0), (2, 0.0)]
    assert ask(mini, "rust rust") == [(1, 2.330069)]
    assert ask(mini, "engine") == [(3, -0.665734), (1, -0.847298), (2, -0.981082)]
    assert ask(mini, "search engine") == [(5, 0.0), (3, -0.665734), (1, -0.847298), (2, -0.981082)]


@pytest.mark.parametrize("mode", ["wand", "bmw", "bmms"])
def test_modes_with_positive_scores_only(mini, mode):
    assert ask(mini, "engine", mode) == []
    assert ask(mini, "rust index", mode) == [(1, 1.165035)]


def test_boolean(mini):
    assert [i for i, _ in ask(mini, "index engine", "boolean")] == [2, 3]
    assert [i for i, _ in ask(mini, "rust", "boolean")] == [1]
    assert ask(mini, "the and", "boolean") == ask(mini, "zzz", "ms") == []
    assert {r["doc_id"] for r in mini.none_of("engine").collect()} == {4}  # the fifth document is the fourth with a token


def test_errors(mini):
    with pytest.raises(ValueError):
        mini.search(" ")
    with pytest.raises(ValueError):
        mini.search("rust zzz", strict=True)
    with pytest.raises(ValueError):
        mini.search("rust", mode="fast")


def test_phrase(mini):
    assert [(r["doc_id"], r["n"]) for r in mini.phrase("index search").collect()] == [(3, 1)]
    assert mini.phrase("engine search").count() == 0


def test_hits_are_remembered(mini):
    assert mini.hits("rust") is mini.hits("rust")


def test_save_and_load(spark, mini, tmp_path):
    mini.save(f"file://{tmp_path}/copy")
    again = Index.load(spark, f"file://{tmp_path}/copy")
    assert ask(again, "rust index") == ask(mini, "rust index")
    assert again.metadata().first()["n_docs"] == 4


def test_fuzzy(spark):
    words = spark.createDataFrame([("hello",), ("help",), ("world",)], "term string")
    assert {r["term"] for r in similar_terms(words, "helo").collect()} == {"hello", "help"}


def test_empty_corpus(spark, tmp_path):
    index = Index.build(spark, spark.createDataFrame([(1, "the"), (2, None)], "doc_id long, text string"), f"file://{tmp_path}/none")
    assert ask(index, "rust") == []
    assert index.metadata().first()["n_docs"] == 0


def corpus(seed, n=300):
    r = random.Random(seed)
    return [(i, " ".join(r.choices("abcdefghij", weights=range(1, 11), k=r.randint(1, 12)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_is_exhaustive(spark, tmp_path, seed):
    # "a" is a stop word; terms are letters with a digit, so that all count.
    docs = [(i, " ".join(w + "1" for w in t.split())) for i, t in corpus(seed)]
    index = Index.build(spark, spark.createDataFrame(docs, "doc_id long, text string"), f"file://{tmp_path}/i", chunk=4)
    r = random.Random(seed)
    for mode in ("bmw", "ms"):
        words = " ".join(r.choices([c + "1" for c in "abcdefghij"], k=3))
        assert ask(index, words, mode, k=5, prune=True) == ask(index, words, mode, k=5)


def test_numbering_by_ranges(spark):
    rows = spark.createDataFrame([("t" if i % 3 else "u", i) for i in range(1, 60)], "term string, doc_id long")
    found = P.numbered(rows, size=7).collect()
    for term in "tu":
        assert [r["rn"] for r in sorted((r for r in found if r["term"] == term), key=lambda r: r["doc_id"])] == list(range(1, 1 + sum(r["term"] == term for r in found)))
    gaps = P.doc_gaps(rows, size=7).collect()
    assert all(r["gap"] == (r["doc_id"] - max((s["doc_id"] for s in gaps if s["term"] == r["term"] and s["doc_id"] < r["doc_id"]), default=0)) for r in gaps)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_postings_without_a_shuffle(spark):
    """Of a document in one row and of one in two."""
    docs = spark.createDataFrame([(1, "b1 a1 b1"), (2, "c1 -- a1"), (3, None), (4, "")], "doc_id long, text string")
    assert exchanges(P.postings(docs)) == 0
    more = docs.unionByName(spark.createDataFrame([(1, "a1 d1")], docs.schema))
    found = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in P.postings(more).collect()}
    assert found == {("b1", 1): (2, [0, 2]), ("a1", 1): (2, [0, 1]), ("d1", 1): (1, [1]), ("c1", 2): (1, [0]), ("a1", 2): (1, [2])}


def test_numbering_shuffles_postings_once(spark):
    """One exchange of postings; the rest are of counts, which are a table by then."""
    rows = spark.createDataFrame([(t, i, "x") for t in "tu" for i in range(40)], "term string, doc_id long, more string")
    found = P.numbered(rows, size=7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("more") and "Join" not in plan and plan.count("Exchange rangepartitioning") == 1
    assert sorted((r["term"], r["doc_id"], r["rn"], r["df"], r["more"]) for r in found.collect()) == [(t, i, i + 1, 40, "x") for t in "tu" for i in range(40)]


def test_parts_are_as_many_as_the_rows_need(spark, monkeypatch):
    """The chunks of a codec, the gaps and the frequencies are sorted in parts of a bounded number of rows."""
    from quern.operators.chunks import encode_chunks

    monkeypatch.setattr(P, "SORTED", 10)
    rows = spark.createDataFrame([(t, i, 1, [i], 0.5, i // 8) for t in "tu" for i in range(1, 41)], "term string, doc_id long, tf int, positions array<int>, score double, chunk_no int")
    for df in (encode_chunks(rows), P.doc_gaps(rows), P.with_df(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert ", 8), REPARTITION_BY_NUM" in plan
        assert df.count() == (12 if "chunk_no" in df.columns and "codec" in df.columns else 80)


@pytest.mark.parametrize("hot", [0, 5, 100])
def test_document_frequency_of_hot_terms(spark, hot):
    rows = spark.createDataFrame([(t, i) for t, n in (("t", 40), ("u", 3)) for i in range(n)], "term string, doc_id long")
    found = P.with_df(rows, hot=hot).collect()
    assert sorted((r["term"], r["doc_id"], r["df"]) for r in found) == sorted((t, i, n) for t, n in (("t", 40), ("u", 3)) for i in range(n))


def test_texts_are_split_once(spark):
    """No filter above computes the tokens again."""
    docs = spark.createDataFrame([(1, "b1 a1 b1")], "doc_id long, text string")
    for df in (P.lengths(docs), P.postings(docs), P.counted(docs).filter("doc_len > 0")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_dense_ids(spark):
    rows = spark.createDataFrame([(x,) for x in random.Random(3).sample(range(10_000), 500)], "k long").repartition(5)
    found = sorted((r["k"], r["dense_id"]) for r in dense_ids(rows, "k").collect())
    assert [i for _, i in found] == list(range(1, 501))


def test_plan_of_a_search(mini):
    """The terms reach the scan, and the best documents are taken without a full sort."""
    plan = R.ranked(mini.table("postings"), {"rust": 1}, "wand")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,rust)" in plan
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_many(spark, mini):
    queries = spark.createDataFrame([(1, "rust index"), (2, "engine"), (3, "zzz")], "query_id int, text string")
    found = sorted((r["query_id"], r["rank"], r["score"]) for r in mini.search_many(queries, mode="ms").collect())
    assert found == [(1, 1, 1.165035), (1, 2, 0.0), (1, 3, 0.0), (2, 1, -0.665734), (2, 2, -0.847298), (2, 3, -0.981082)]




def test_metadata_says_that_postings_are_not_encoded(spark):
    from quern.plans.index import Index

    meta = Index.build(spark, spark.createDataFrame([(1, "rust engine")], "doc_id long, text string"), codec="rice").metadata().first()
    assert meta["codec"] == "rice" and meta["postings_encoded"] is False
