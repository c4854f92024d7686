import json

import zstandard
from pyspark.sql import functions as F

from quern.cli import Config, run
from quern.sources import articles as A
from quern.streaming.ingest import collect_articles, watch


def lines(*texts):
    return [json.dumps({"id": str(i), "url": f"u{i}", "title": f"t{i}", "text": t}) for i, t in enumerate(texts)]


def put(path, rows, packed=True, end=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = ("\n".join(rows) + end).encode()
    path.write_bytes(zstandard.ZstdCompressor().compress(data) if packed else data)


def test_every_line_is_read(spark, tmp_path):
    put(tmp_path / "a.zst", lines("one engine", "the", "two engine"))
    put(tmp_path / "deep" / "er" / "b.zst", [*lines("x"), "{broken", json.dumps({"url": "only"})])
    put(tmp_path / "c.txt", lines("not read"), packed=False)
    found = A.read_lines(spark, f"file://{tmp_path}")
    assert found.count() == 6
    assert sorted(r["text"] for r in A.articles(found).collect()) == ["one engine", "the", "two engine", "x"]


def test_dump(spark, tmp_path):
    page = "<page><id>{}</id><ns>{}</ns><title>T</title>{}<revision><timestamp>1</timestamp><text>old</text></revision><revision><timestamp>2</timestamp><text>{}</text></revision></page>"
    body = "<x>" + page.format(1, 0, "", "new [[Category:C]]") + page.format(2, 1, "", "talk") + page.format(3, 0, "<redirect>R</redirect>", "r") + page.format(4, 0, "", "") + "</x>"
    (tmp_path / "d.xml").write_text(body)
    rows = A.dump_articles(A.read_dump(spark, f"file://{tmp_path}/d.xml"), "base/").collect()
    assert [(r["id"], r["url"], r["text"], r["title"]) for r in rows] == [(1, "base/1", "new", "T")]


def test_wiki_text(spark):
    row = spark.createDataFrame([("== A ==\nx\n==Notes==\ngone\n=== Sub ===\ngone\n== B ==\n''y'' [[T|s]] {{a|{{b}}}}\n==External links==\ngone",)], "t string")
    assert row.select(A.clean_wiki_text(F.col("t")).alias("t")).first()["t"].split() == ["A", "x", "B", "y", "s"]


def test_templates_and_sections_of_any_depth(spark):
    deep = "{{t|" * 9 + "x" + "}}" * 9
    texts = [f"a {deep}b", "a {{{x}}{y}}b", "a {b} {{c", "{{x}} " * 50 + "a", None]
    texts += [f"a\n{'=' * k} Notes {'=' * k}\ngone\n{'=' * k} B {'=' * k}\nb" for k in range(1, 7)]
    texts += ["a\n==== Notes ====\ngone\n===== Sub =====\ngone\n== B ==\nb", "a\n= References =\ngone\n== Sub ==\ngone"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r["t"] for r in rows.select("i", A.clean_wiki_text(F.col("t")).alias("t")).orderBy("i").collect()]
    assert found == ["a b", "a b", "a {b} {{c", "a", None, *["a B b"] * 7, "a"]


def test_texts_are_cleaned_once(spark):
    """The filter on the cleaned text doesn't clean it again."""
    rows = spark.createDataFrame([(1, 0, "t", None, [("2001", "== See also ==\nx\n== A ==\n{{a}} b"), ("2002", "{ no markup }")]), (2, 0, "t", None, [("2001", "{{a}}\n== Notes ==\nx")])], "id long, ns int, title string, redirect string, revision array<struct<timestamp string, text string>>")
    found = A.dump_articles(rows, "u")
    nodes = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Category" in n for n in nodes) == 1
    assert [(r["id"], r["text"]) for r in found.collect()] == [(1, "{ no markup }")]


def test_batches(spark, tmp_path):
    A.write_batches(spark.range(1201).coalesce(1), f"file://{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 3


def test_stream(spark, tmp_path):
    put(tmp_path / "in" / "a.json", lines("one engine", "the"), packed=False)
    table = f"file://{tmp_path}/table"

    def go():
        collect_articles(watch(spark, f"file://{tmp_path}/in"), table, f"file://{tmp_path}/mark").awaitTermination(120)
        return sorted(r["text"] for r in spark.read.parquet(table).collect())

    assert go() == ["one engine"]
    put(tmp_path / "in" / "b.json", [*lines("two"), "{broken"], packed=False)
    assert go() == go() == ["one engine", "two"]


def test_commands(spark, tmp_path):
    put(tmp_path / "data" / "a.zst", lines("rust engine", "index engine", "search words"))
    config = Config(str(tmp_path / "data"), f"file://{tmp_path}/index")
    said = list(run(spark, config, ["", "query rust", "what", "index", "query rust", "query  ", "terms", "metadata", "help", "quit", "help"]))
    assert said[0].startswith("no index") and said[1].startswith("no command") and said[2] == "indexed 3 documents"
    assert said[3].endswith("t0 u0") and said[4] == "blank query"
    assert said[5:10] == ["engine", "index", "rust", "search", "words"]
    assert json.loads(said[10])["n_docs"] == 3 and len(said) == 12
    assert list(run(spark, config, ["load", "query search"]))[1].endswith("t2 u2")


def test_articles_that_share_a_url_are_all_indexed(spark, tmp_path):
    row = lambda title, text: json.dumps({"url": "u", "title": title, "text": text})
    put(tmp_path / "data" / "a.zst", [row("t", "rust"), row("t", "index"), row("s", "rust"), row("t", "rust")])
    said = list(run(spark, Config(str(tmp_path / "data"), f"file://{tmp_path}/index", mode="boolean"), ["index", "query rust", "query index"]))
    assert said[0] == "indexed 4 documents"
    assert sorted(x.split(" ", 1)[1] for x in said[1:4]) == ["s u", "t u", "t u"] and said[4].endswith("t u") and len(said) == 5


def test_config(tmp_path):
    assert Config.load(str(tmp_path / "none")) == Config()
    (tmp_path / "c").write_text('{"mode": "bmw", "more": 1}')
    assert Config.load(str(tmp_path / "c")).mode == "bmw"
