"""Queries against their SQL on the smallest tables."""

import math
import pathlib

import duckdb
import pytest

from quern.plans.queries import QUERIES

DATA = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    query, sql = QUERIES[name]
    found = query(spark, str(DATA))
    columns = sorted(found.columns)
    wanted = tables.execute(sql)
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in wanted.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect()) == want


def test_documents_without_language_and_their_texts(spark, tmp_path):
    from quern.plans import queries as Q
    from quern.plans.workspace import workspace

    rows = [(1, "rust engine", "en"), (2, "rust", "de"), (3, "rust index", None), (4, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"file://{tmp_path}/nolang/documents.parquet")
    found = {(r["term"], r["doc_id"], r["tf"]) for r in Q.posting_merge(spark, f"file://{tmp_path}/nolang").collect()}
    assert found == {("rust", 1, 1), ("engine", 1, 1), ("rust", 2, 1), ("rust", 3, 1), ("index", 3, 1)}
    assert Q.batch_sink(spark, f"file://{tmp_path}/nolang").first()["n"] == 4
    written = spark.read.parquet(f"{workspace(spark)}/batches-nolang")
    assert sorted(map(repr, written.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
