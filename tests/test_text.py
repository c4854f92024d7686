import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions import text
from quern.plans.index import query_terms

SAMPLES = {
    "Rust, the rust engine!": [(0, "rust"), (2, "rust"), (3, "engine")],
    "An engine for index": [(1, "engine"), (3, "index")],
    "Index merge: index search engine": [(0, "index"), (1, "merge"), (2, "index"), (3, "search"), (4, "engine")],
    "Don't the café": [],
    "fast-path (search)": [(0, "fast-path"), (1, "search")],
    "gear11110114dnpdnpdnpdnp210daniel a-b u.s. 42": [(1, "a-b"), (3, "42")],
    "  \t\n": [],
    "": [],
    " left right　": [(0, "left"), (1, "right")],
    "will or OR": [(1, "or"), (2, "or")],
}


def test_tokens_and_positions(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)] + [(99, None)], "id int, text string")
    found = {}
    for r in text.tokenize(rows, "text", "id").collect():
        found.setdefault(r["id"], []).append((r["pos"], r["term"]))
    assert [sorted(found.get(i, [])) for i in range(len(SAMPLES))] == list(SAMPLES.values())
    assert 99 not in found


def test_stop_words():
    assert len(set(text.STOP_WORDS)) == len(text.STOP_WORDS) == 60
    assert "or" not in text.STOP_WORDS


def test_query_uses_the_same_tokenizer(spark):
    assert query_terms(spark, "Rust, the rust engine!") == [("rust", 0), ("rust", 2), ("engine", 3)]
    with pytest.raises(ValueError):
        query_terms(spark, " \t")


def test_flatten(spark):
    rows = spark.createDataFrame([([["<b>One.", " Two."], ["Three</b>."]],)], "text array<array<string>>")
    assert rows.select(text.flatten_paragraphs("text").alias("t")).first()["t"] == "One. Two.\n\nThree."


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_length_is_number_of_tokens(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lengths = {r["id"]: r["n"] for r in rows.select("id", text.doc_length("text").alias("n")).collect()}
    tokens = {r["id"]: r["count"] for r in text.tokenize(rows, "text", "id").groupBy("id").count().collect()}
    assert {i: n for i, n in lengths.items() if n} == tokens
