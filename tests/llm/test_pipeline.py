import hashlib

import pytest

import corpus_pipeline as C
from quern.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    bad = [(i, f"plain words here {i} " * 5 + ("grumpf snarkle " * 2 if i % 2 else "")) for i in range(1000, 1120)]
    spark.createDataFrame(bad, "doc_id long, text string").selectExpr("doc_id", "text", "'b1' AS source", *(f"{c} AS `{c}`" for c in ())).createOrReplaceTempView("bad")
    more = spark.table("bad")
    for f in docs.schema.fields[3:]:
        more = more.selectExpr("*", f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`")
    more.write.mode("append").parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 2)) for i, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_names():
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]


def test_stages(spark, folder):
    docs = start = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.schema.names == start.schema.names, name
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append(docs.collect())
    ids = [[r["doc_id"] for r in k] for k in kept]
    assert not [i for i in ids[0] if i and i >= 1000 and i % 2] and len([i for i in ids[0] if i and i >= 1000]) == 60
    before = {}
    for r in kept[0]:
        before.setdefault(r["text"] or "", []).append(r["doc_id"])
    want = sorted((-1 if max((x for x in v if x is not None), default=None) is None else max(x for x in v if x is not None)) for v in before.values())
    assert sorted(-1 if i is None else i for i in ids[1]) == want
    assert len({r["text"] or "" for r in kept[1]}) == len(kept[1])
    assert set(map(repr, kept[2])) <= set(map(repr, kept[1])) and len(kept[2]) < len(kept[1])
    times = {}
    for r in kept[3]:
        times[repr(r)] = times.get(repr(r), 0) + 1
    assert set(times) <= set(map(repr, kept[2])) and max(times.values()) <= 2
    out = C.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(r["decoded_sha256"] for r in out) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in kept[3])
    vocab = bpe.vocabulary(bpe.default_path())
    assert sorted(vocab.decode(r["ids"]) for r in out) == sorted(r["text"] or "" for r in kept[3])
    run = C.run(spark, folder).collect()
    assert sorted(map(repr, run)) == sorted(map(repr, out))


def test_empty(spark, folder, none):
    docs = none
    for _, stage in C.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_near_copies_take_few_tables(spark, docs, folder, monkeypatch):
    """Places beyond a block aren't split again, and few links need no turns."""
    written = []
    monkeypatch.setattr(C.near_dedup, "CAP", 3)
    monkeypatch.setattr(C.near_dedup, "materialize", lambda df, name, real=C.near_dedup.materialize: written.append(name) or real(df, name))
    kept = C.drop_near_copies(spark, docs, folder).collect()
    assert written.count("places") == written.count("edges") == 1
    monkeypatch.undo()
    assert sorted(map(repr, kept)) == sorted(map(repr, C.drop_near_copies(spark, docs, folder).collect()))


@pytest.mark.parametrize("stage", [C.drop_near_copies, C.mix])
def test_texts_are_read_twice(spark, folder, docs, stage):
    """Once for what the stage finds, once for what it returns; that rows are alike is known without their texts."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    got = stage(spark, docs.mapInArrow(counted, docs.schema), folder).collect()
    assert read.value == 2 * docs.count()
    assert sorted(map(repr, got)) == sorted(map(repr, stage(spark, docs, folder).collect()))
