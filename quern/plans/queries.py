"""Queries over the driver's tables for every operator, and the same in SQL.

documents is the corpus (identifier doc_id, title doc-<doc_id>, url its source), pages the raw pages. A
folder's index is built once in a session and its tables are read from then on.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import bm25, codecs, text
from quern.operators import postings as P
from quern.operators import retrieval as R
from quern.operators.chunks import decode_chunks, encode_chunks
from quern.operators.fuzzy import similar_terms
from quern.operators.ids import dense_ids
from quern.plans.index import Index, query_terms
from quern.plans.workspace import spread, write_table
from quern.sources import articles as A

Query = Callable[[SparkSession, str], DataFrame]
_indexes: dict[tuple[str, str, float], Index] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The folder's index; built anew if its documents changed."""
    path = f"{sf_dir}/documents.parquet"
    changed = os.path.getmtime(path) if os.path.exists(path) else 0.0
    key = (spark.sparkContext.applicationId, sf_dir, changed)
    if key not in _indexes:
        _indexes[key] = Index.build(spark, documents(spark, sf_dir).select("doc_id", "text", "source"), url="source")
    return _indexes[key]


def _stop() -> str:
    return ", ".join(f"'{w}'" for w in text.STOP_WORDS)


#: Common table expressions; each may use those before it.
_WITH = {
    "w": r"SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x{00a0}]+'), lambda x: x <> '') AS w FROM documents",
    "tok": r"SELECT doc_id, pos, lower(regexp_replace(raw, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS term FROM (SELECT doc_id, unnest(range(len(w)))::INTEGER AS pos, unnest(w) AS raw FROM w)",
    "t": f"SELECT * FROM tok WHERE regexp_full_match(term, '[a-z0-9-]{{1,20}}') AND term NOT IN ({_stop()})",
    "l": "SELECT doc_id, count(*) AS doc_len FROM t GROUP BY doc_id",
    "s": "SELECT count(*) AS n_docs, sum(doc_len)::BIGINT AS n_tokens, avg(doc_len) AS avgdl FROM l",
    "p": "SELECT term, doc_id, count(*)::INTEGER AS tf, list(pos ORDER BY pos) AS positions FROM t GROUP BY term, doc_id",
    "f": "SELECT term, count(*) AS df FROM p GROUP BY term",
    "ids": "SELECT doc_id AS ext_id, row_number() OVER (ORDER BY doc_id) AS id, doc_len FROM l",
    "sp": "SELECT term, doc_id, tf, positions, df, ln((n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl)) AS score FROM p JOIN f USING (term) JOIN l USING (doc_id), s",
    "c": "SELECT term, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128 AS chunk_no, id, score FROM sp JOIN ids ON ext_id = doc_id",
}


def _sql(last: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _WITH.items()) + " " + last


def _bag(words: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in words.split():
        out[w] = out.get(w, 0) + 1
    return out


def _values(bag: dict[str, int]) -> str:
    return "(VALUES " + ", ".join(f"('{t}', {n})" for t, n in bag.items()) + ") AS q(term, qtf)"


_RANKED = "SELECT doc_id, round(sum(qtf * score), 6) + 0.0 AS score FROM sp JOIN {q} USING (term) GROUP BY doc_id"


def _ranked_sql(words: str, k: int | None, positive: bool) -> str:
    return _sql(f"SELECT * FROM ({_RANKED.format(q=_values(_bag(words)))}) {'WHERE score > 0' if positive else ''} ORDER BY score DESC, doc_id DESC {f'LIMIT {k}' if k else ''}")


def _search(words: str, mode: str, **more: object) -> Query:
    return lambda spark, sf: index_of(spark, sf).search(words, mode=mode, **more).select(F.col("ext_id").alias("doc_id"), "score")


def _out(found: DataFrame, index: Index) -> DataFrame:
    return found.join(index.table("docs"), "doc_id").select(F.col("ext_id").alias("doc_id"))


def tokenize_documents(spark: SparkSession, sf: str) -> DataFrame:
    return text.tokenize(documents(spark, sf), "text", "doc_id")


QUERY_TEXT = "  The Rust-engine, don't (INDEX) café state-of-the-art 42 will or x "


def tokenize_query(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(query_terms(spark, QUERY_TEXT), "term string, pos int").select("pos", "term")


def doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return P.lengths(documents(spark, sf)).select("doc_id", F.col("doc_len").cast("long").alias("doc_len"))


def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return P.collection(P.lengths(documents(spark, sf))).select("n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"))


def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    # Each term of a document once, in its row: only counts are shuffled.
    terms = documents(spark, sf).select(text.once(F.array_distinct(text.token_array(F.col("text")))).alias("terms")).select(F.explode("terms").alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return P.postings(documents(spark, sf)).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def dense_doc_ids(spark: SparkSession, sf: str) -> DataFrame:
    # Written, for choosing the ranges reads the rows once more, and would split each text into words again.
    rows = write_table(P.lengths(documents(spark, sf)), "lengths")
    return dense_ids(rows, "doc_id").select("doc_id", "dense_id")


def term_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return dense_ids(document_frequency(spark, sf), "term", name="term_id").select("term_id", "term", "df")


def idf_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    stats = P.collection(P.lengths(docs))
    return document_frequency(spark, sf).crossJoin(F.broadcast(stats)).select("term", bm25.rounded(bm25.idf(F.col("n_docs"), F.col("df"))).alias("idf"))


def posting_scores(spark: SparkSession, sf: str) -> DataFrame:
    # Each text is split into words once; its terms are written with how often they occur, without positions.
    docs = P.counted(documents(spark, sf))
    terms = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), F.size(t["positions"]).alias("tf")))
    docs = write_table(docs.select("doc_id", "doc_len", terms.alias("terms")), "counted").filter("doc_len > 0")
    posts = docs.select("doc_id", "doc_len", F.inline("terms"))
    return P.with_scores(P.with_df(posts), P.collection(docs)).select("term", "doc_id", bm25.rounded(F.col("score")).alias("score"))


def term_max_score(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).table("terms").select("term", "df", bm25.rounded(F.col("max_score")).alias("max_score"))


def block_max_128(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).table("block_max").select("term", "chunk_no", "first_doc", "last_doc", "n", bm25.rounded(F.col("max_score")).alias("max_score"))


def dgaps(spark: SparkSession, sf: str) -> DataFrame:
    return P.doc_gaps(index_of(spark, sf).table("postings"))


def varbyte_size_per_term(spark: SparkSession, sf: str) -> DataFrame:
    return dgaps(spark, sf).groupBy("term").agg(F.sum(codecs.varbyte_size(F.col("gap"))).alias("bytes"))


def bm25_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return _search("re es th st ou", "bmw", prune=True)(spark, sf)


#: query_id, text.
MANY = ((1, "ering tion eau"), (2, "en er ering"), (3, "tion tion ha"), (4, "re es th st ou"), (5, "zzzz"))


def bm25_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    index = index_of(spark, sf)
    found = index.search_many(spark.createDataFrame(MANY, "query_id int, text string"), k=20, mode="bmw")
    return found.join(index.table("docs"), "doc_id").select("query_id", F.col("rank").cast("long").alias("rank"), F.col("ext_id").alias("doc_id"), "score")


def boolean_and(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).search("tion ering", mode="boolean").select(F.col("ext_id").alias("doc_id"), "score")


def boolean_or(spark: SparkSession, sf: str) -> DataFrame:
    index = index_of(spark, sf)
    return _out(index.any_of("eau ering"), index)


def boolean_not(spark: SparkSession, sf: str) -> DataFrame:
    index = index_of(spark, sf)
    return _out(index.none_of("en"), index)


def boolean_and_not(spark: SparkSession, sf: str) -> DataFrame:
    index = index_of(spark, sf)
    return _out(R.all_of(index.table("postings"), {"tion": 1, "re": 1}).join(index.any_of("ering"), "doc_id", "left_anti"), index)


def fuzzy_terms(spark: SparkSession, sf: str) -> DataFrame:
    return similar_terms(document_frequency(spark, sf).select("term"), "ering", 1)


def fuzzy_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a term near the word, ranked by the sum of all such terms."""
    index = index_of(spark, sf)
    # The near terms are a subset of the dictionary of unknown size, so they are joined, not listed.
    near = index.similar("ering", 1).select(F.lit(1).alias("query_id"), "term", F.lit(1).cast("long").alias("qtf"))
    found = R.ranked_many(index.table("postings"), near, "bmw")
    return found.join(index.table("docs"), "doc_id").select(F.col("ext_id").alias("doc_id"), "score")


def index_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).metadata().select("n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"), "n_terms", F.col("max_length").cast("long").alias("max_length"), "n_chunks", "codec", (F.col("size_gb") > 0).alias("stored"))


def terms_listing(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).terms(8).select("term_id", "term")


def terms_listing_all(spark: SparkSession, sf: str) -> DataFrame:
    """All terms, of any length that the operator lists by default."""
    return index_of(spark, sf).terms().select("term_id", "term")


def doc_metadata_join(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).search("ering tion eau", k=20).select("doc_id", "ext_id", "title", "url", F.col("doc_len").cast("long").alias("doc_len"), "score")


def saved_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same search on a copy of the index that was saved and loaded."""
    index = index_of(spark, sf)
    copy = Index.load(spark, index.save(f"{index.path}-copy").path)
    return copy.search("en er ering", mode="bmw").select(F.col("ext_id").alias("doc_id"), "score")


def labelled_search(spark: SparkSession, sf: str) -> DataFrame:
    """Best documents among those labelled good and not toxic."""
    index = index_of(spark, sf)
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 and toxic = 0").select(F.col("doc_id").alias("ext_id"))
    found = R.totals(index.table("postings"), _bag("tion re es"))
    found = found.join(index.table("docs").select("doc_id", "ext_id"), "doc_id").join(good, "ext_id", "left_semi")
    return R.best(found.select(F.col("ext_id").alias("doc_id"), "score"), 20, True)


def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    index = index_of(spark, sf)
    return index.phrase("tion re").join(index.table("docs"), "doc_id").select(F.col("ext_id").alias("doc_id"), "n")


def conversation_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies of another corpus: turns of conversations."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return text.tokenize(rows, "text", "conv_id", "turn").distinct().select("conv_id", "turn", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def html_strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), text.strip_tags(F.col("html")).alias("text"))


def page_articles(spark: SparkSession, sf: str) -> DataFrame:
    """id, url, text, title of pages as articles; those without text are dropped."""
    rows = pages(spark, sf).select("page_id", F.col("url"), A.one_line(F.trim(text.strip_tags(F.col("html")))).alias("text"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return rows.filter("text <> ''")


def plaintext_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of sentences as text: here lines are paragraphs, cut after periods."""
    paragraphs = F.transform(F.split("text", "\n"), lambda p: F.split(p, r"(?<=\.) "))
    return documents(spark, sf).select("doc_id", text.flatten_paragraphs(paragraphs).alias("plain"))


_WIKI = "== Intro ==\n'''%s''' is [[Target|shown]] and [[plain]] {{tpl|a={{b}}}}.<ref>r</ref>\n\n== See also ==\n* [[x]]\n=== Sub ===\ny\n== After ==\n\"q\" [[Category:First]]\n[[Category:Second|key]]\n== References ==\nend"


def _wiki(spark: SparkSession, sf: str) -> DataFrame:
    """One dump page for each page of the table."""
    t = F.replace(F.lit(_WIKI), F.lit("%s"), F.regexp_extract("html", "<title>([^<]*)", 1))
    return pages(spark, sf).select(F.col("page_id").alias("id"), (F.col("page_id") % 3).cast("int").alias("ns"), F.when(F.col("page_id") % 5 == 0, F.lit("Elsewhere")).alias("redirect"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.array(F.struct(F.lit("2001").alias("timestamp"), F.lit("old").alias("text")), F.struct(F.lit("2002").alias("timestamp"), F.when(F.col("page_id") % 7 != 0, t).alias("text"))).alias("revision"))


def wiki_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return A.dump_articles(_wiki(spark, sf), "https://wiki.example.org/?curid=").select("id", "url", "text", "title")


def wiki_clean_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's whole body cleaned, as the one revision of an article; none is left out by its identifier."""
    revision = F.array(F.struct(F.lit("2001").alias("timestamp"), F.col("html").alias("text")))
    rows = pages(spark, sf).select(F.col("page_id").alias("id"), F.lit(0).alias("ns"), F.lit(None).cast("string").alias("redirect"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), revision.alias("revision"))
    return A.dump_articles(rows, "https://wiki.example.org/?curid=").select("id", "url", "text", "title")


#: Patterns that leave nothing or their first group. The tables have no listed sections and no nested templates.
_CLEANED = "html"
for _pattern, _left in (
    (r"\[\[Category:[^\]]*\]\]", ""),
    (r"(?s)<!--.*?-->|<ref[^>]*/>|<ref[^>]*>.*?</ref>", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", r"\1"),
    (r"\[https?://[^ \]]*[ ]?([^\]]*)\]", r"\1"),
    (r"<[^>]*>|''{2,5}", ""),
    (r"(?m)^=+[ \t]*(.*?)[ \t]*=+[ \t]*$", r"\1"),
    (r"^\s+|\s+$", ""),
):
    _CLEANED = f"regexp_replace({_CLEANED}, '{_pattern}', '{_left}', 'g')"


def categories_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _wiki(spark, sf).select("id", F.array_join(A.categories(A.last_revision(F.col("revision"))), ";").alias("categories"))


def corpus_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Which pages are kept as articles."""
    rows = _wiki(spark, sf)
    return rows.filter(A.is_article(F.col("ns"), F.col("redirect")) & A.last_revision(F.col("revision")).isNotNull()).select("id")


def sanitize_title(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", A.sanitize_title(F.concat(F.col("url"), F.lit(" a\tb "), F.col("html"))).alias("name"))


def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Articles written as JSON lines, with a broken line among them, and read back."""
    from quern.plans.workspace import workspace

    path = f"{workspace(spark)}/lines-{os.path.basename(sf.rstrip('/'))}"
    rows = documents(spark, sf).select(F.col("source").alias("url"), "text", F.concat(F.lit("doc-"), "doc_id").alias("title"))
    A.write_batches(rows, f"{path}/whole", format="json")
    spark.createDataFrame([("{broken",), ('{"url": "u"}',)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/broken.json")
    found = A.articles(A.read_lines(spark, path, pattern="*.{json,gz,txt}"))
    return found.groupBy("url").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("n_chars"))


def batch_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written in batches of 500 and read back."""
    from quern.plans.workspace import workspace

    path = f"{workspace(spark)}/batches-{os.path.basename(sf.rstrip('/'))}"
    A.write_batches(documents(spark, sf), path)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    return per_file.agg(F.sum("n").alias("n"), (F.max("n") <= A.BATCH).alias("small"))


def _codec(name: str, with_gaps: bool) -> Query:
    """Encoded and decoded identifiers of each term's postings, in chunks of 128."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        posts = index_of(spark, sf).table("postings").select("term", "chunk_no", "doc_id")
        lists = P.in_parts(posts, "term", "chunk_no").groupBy("term", "chunk_no").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
        lists = lists.withColumn("data", codecs.encode(F.col("ids"), name, with_gaps))
        back = codecs.decode(F.col("data"), name, with_gaps)
        return lists.select("term", "chunk_no", F.size("ids").cast("long").alias("n"), (back == F.col("ids")).alias("same"))

    return run


_CODEC_SQL = _sql("SELECT term, chunk_no, count(*) AS n, true AS same FROM c GROUP BY term, chunk_no")


def chunk_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Postings out of compressed chunks again."""
    posts = index_of(spark, sf).table("postings")
    found = decode_chunks(encode_chunks(posts.filter(F.col("term").isin("tion", "en", "ering", "re")), "pfordelta"), "pfordelta")
    return found.select("term", "chunk_no", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def chunk_round_trip_all(spark: SparkSession, sf: str) -> DataFrame:
    """The postings of all terms out of compressed chunks again."""
    found = decode_chunks(encode_chunks(index_of(spark, sf).table("postings"), "pfordelta"), "pfordelta")
    return found.select("term", "chunk_no", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def posting_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of each language by itself, merged."""
    docs = documents(spark, sf)
    runs = [P.postings(docs.filter(c)) for c in ("lang = 'en'", "lang = 'de'", "coalesce(lang, '') NOT IN ('en', 'de')")]
    return P.merge_runs(*runs).select("term", "doc_id", "tf")


def boolean_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    index = index_of(spark, sf)
    return _out(R.both(index.table("postings"), "tion", "ering"), index)


def transliterated_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", text.transliterate(F.col("text")).alias("text"))
    return text.tokenize(rows, "text", "doc_id").groupBy("term").agg(F.count("*").alias("n"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "tokenize_documents": (tokenize_documents, _sql("SELECT doc_id, pos, term FROM t")),
    "tokenize_query": (tokenize_query, "SELECT * FROM (VALUES (1, 'rust-engine'), (3, 'index'), (5, 'state-of-the-art'), (6, '42'), (8, 'or'), (9, 'x')) AS q(pos, term)"),
    "doc_lengths": (doc_lengths, _sql("SELECT doc_id, doc_len FROM l")),
    "collection_stats": (collection_stats, _sql("SELECT n_docs, n_tokens, round(avgdl, 6) AS avgdl FROM s")),
    "document_frequency": (document_frequency, _sql("SELECT term, df FROM f")),
    "postings": (postings, _sql("SELECT term, doc_id, tf, array_to_string(positions, ',') AS positions FROM p")),
    "dense_doc_ids": (dense_doc_ids, _sql("SELECT ext_id AS doc_id, id AS dense_id FROM ids")),
    "term_dictionary": (term_dictionary, _sql("SELECT row_number() OVER (ORDER BY term) AS term_id, term, df FROM f")),
    "idf_table": (idf_table, _sql("SELECT term, round(ln((n_docs - df + 0.5) / (df + 0.5)), 6) + 0.0 AS idf FROM f, s")),
    "posting_scores": (posting_scores, _sql("SELECT term, doc_id, round(score, 6) + 0.0 AS score FROM sp")),
    "term_max_score": (term_max_score, _sql("SELECT term, count(*) AS df, round(max(score), 6) + 0.0 AS max_score FROM sp GROUP BY term")),
    "block_max_128": (block_max_128, _sql("SELECT term, chunk_no, min(id) AS first_doc, max(id) AS last_doc, count(*) AS n, round(max(score), 6) + 0.0 AS max_score FROM c GROUP BY term, chunk_no")),
    "dgaps": (dgaps, _sql("SELECT term, id AS doc_id, id - lag(id, 1, 0) OVER (PARTITION BY term ORDER BY id) AS gap FROM c")),
    "varbyte_size_per_term": (
        varbyte_size_per_term,
        _sql("SELECT term, sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 ELSE 4 END)::BIGINT AS bytes FROM (SELECT term, id - lag(id, 1, 0) OVER (PARTITION BY term ORDER BY id) AS gap FROM c) GROUP BY term"),
    ),
    "bm25_wand_top50": (_search("ering tion eau", "wand"), _ranked_sql("ering tion eau", 50, True)),
    "bm25_bmw_top20": (_search("en er ering", "bmw"), _ranked_sql("en er ering", 20, True)),
    "bm25_maxscore_top20": (_search("re es th st ou", "ms"), _ranked_sql("re es th st ou", 20, False)),
    "bm25_bmms_top20": (_search("re es th st ou", "bmms"), _ranked_sql("re es th st ou", 20, True)),
    "bm25_pruned": (bm25_pruned, _ranked_sql("re es th st ou", 20, True)),
    "bm25_duplicate_terms": (_search("tion tion ha", "bmw"), _ranked_sql("tion tion ha", 20, True)),
    "bm25_negative_idf": (_search("en", "ms"), _ranked_sql("en", 20, False)),
    "bm25_negative_idf_wand": (_search("en", "wand"), _ranked_sql("en", 50, True)),
    "bm25_unknown_terms": (_search("zzzz ering qqqq", "bmw"), _ranked_sql("zzzz ering qqqq", 20, True)),
    "bm25_multi_query": (
        bm25_multi_query,
        _sql(
            "SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM ("
            + " UNION ALL ".join(f"SELECT {i} AS query_id, * FROM ({_RANKED.format(q=_values(_bag(t)))})" for i, t in MANY)
            + ") WHERE score > 0) WHERE rank <= 20"
        ),
    ),
    "boolean_and": (boolean_and, _sql("SELECT doc_id, 0.0::DOUBLE AS score FROM p WHERE term IN ('tion', 'ering') GROUP BY doc_id HAVING count(*) = 2")),
    "boolean_or": (boolean_or, _sql("SELECT DISTINCT doc_id FROM p WHERE term IN ('eau', 'ering')")),
    "boolean_not": (boolean_not, _sql("SELECT doc_id FROM l WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'en')")),
    "boolean_and_not": (boolean_and_not, _sql("SELECT doc_id FROM p WHERE term IN ('tion', 're') AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'ering') GROUP BY doc_id HAVING count(*) = 2")),
    "fuzzy_terms": (fuzzy_terms, _sql("SELECT term, levenshtein(term, 'ering')::INTEGER AS distance FROM f WHERE levenshtein(term, 'ering') <= 1")),
    "fuzzy_search": (fuzzy_search, _sql("SELECT * FROM (SELECT doc_id, round(sum(score), 6) + 0.0 AS score FROM sp WHERE levenshtein(term, 'ering') <= 1 GROUP BY doc_id) WHERE score > 0 ORDER BY score DESC, doc_id DESC LIMIT 20")),
    "index_metadata": (
        index_metadata,
        _sql("SELECT n_docs, n_tokens, round(avgdl, 6) AS avgdl, n_terms, max_length, n_chunks, 'simple16' AS codec, true AS stored FROM s, (SELECT count(*) AS n_terms, max(length(term)) AS max_length FROM f), (SELECT count(*) AS n_chunks FROM (SELECT DISTINCT term, chunk_no FROM c))"),
    ),
    "terms_listing": (terms_listing, _sql("SELECT term_id, term FROM (SELECT row_number() OVER (ORDER BY term) AS term_id, term FROM f) WHERE length(term) <= 8")),
    "terms_listing_all": (terms_listing_all, _sql("SELECT term_id, term FROM (SELECT row_number() OVER (ORDER BY term) AS term_id, term FROM f) WHERE length(term) <= 20")),
    "doc_metadata_join": (
        doc_metadata_join,
        _sql(f"SELECT id AS doc_id, ext_id, 'doc-' || ext_id AS title, source AS url, doc_len, score FROM (SELECT * FROM ({_RANKED.format(q=_values(_bag('ering tion eau')))}) WHERE score > 0 ORDER BY score DESC, doc_id DESC LIMIT 20) r JOIN ids ON ext_id = r.doc_id JOIN documents d ON d.doc_id = ext_id"),
    ),
    "saved_index_search": (saved_index_search, _ranked_sql("en er ering", 20, True)),
    "labelled_search": (
        labelled_search,
        _sql(f"SELECT * FROM ({_RANKED.format(q=_values(_bag('tion re es')))}) WHERE score > 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) ORDER BY score DESC, doc_id DESC LIMIT 20"),
    ),
    "phrase_match": (phrase_match, _sql("SELECT a.doc_id, count(*) AS n FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'tion' AND b.term = 're' GROUP BY a.doc_id")),
    "conversation_terms": (
        conversation_terms,
        r"WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\s\x{00a0}]+'), lambda x: x <> '') AS w FROM conversations), tok AS (SELECT conv_id, turn, lower(regexp_replace(raw, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS term FROM (SELECT conv_id, turn, unnest(w) AS raw FROM w)) SELECT term, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, term FROM tok WHERE regexp_full_match(term, '[a-z0-9-]{1,20}') AND term NOT IN ("
        + _stop()
        + ")) GROUP BY term",
    ),
    "html_strip_tags": (html_strip_tags, "SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages"),
    "page_articles": (
        page_articles,
        "SELECT * FROM (SELECT page_id, url, replace(replace(trim(regexp_replace(html, '<[^>]*>', '', 'g'), ' '), chr(10), ' '), '\"', '') AS text, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages) WHERE text <> ''",
    ),
    "plaintext_flatten": (plaintext_flatten, r"SELECT doc_id, regexp_replace(replace(regexp_replace(text, '\. ', '.', 'g'), chr(10), chr(10) || chr(10)), '<[^>]*>', '', 'g') AS plain FROM documents"),
    "wiki_clean_text": (
        wiki_clean_text,
        "SELECT page_id AS id, 'https://wiki.example.org/?curid=' || page_id AS url, 'Intro ' || title || ' is shown and plain .  After q' AS text, title FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages) WHERE page_id % 3 = 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0",
    ),
    "wiki_clean_bodies": (
        wiki_clean_bodies,
        f"SELECT * FROM (SELECT page_id AS id, 'https://wiki.example.org/?curid=' || page_id AS url, replace(replace({_CLEANED}, chr(10), ' '), '\"', '') AS text, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages) WHERE text <> ''",
    ),
    "categories_extract": (categories_extract, "SELECT page_id AS id, CASE WHEN page_id % 7 <> 0 THEN 'First;Second' END AS categories FROM pages"),
    "corpus_filter": (corpus_filter, "SELECT page_id AS id FROM pages WHERE page_id % 3 = 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0"),
    "sanitize_title": (sanitize_title, r"""SELECT page_id, substring(regexp_replace(regexp_replace(url || ' a' || chr(9) || 'b ' || html, '[\\/*?:"<>|]', '_', 'g'), '\s+', '_', 'g'), 1, 200) AS name FROM pages"""),
    "jsonl_round_trip": (jsonl_round_trip, "SELECT source AS url, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY source"),
    "batch_sink": (batch_sink, "SELECT count(*) AS n, true AS small FROM documents"),
    "chunk_round_trip": (
        chunk_round_trip,
        _sql("SELECT term, (row_number() OVER (PARTITION BY term ORDER BY p.doc_id) - 1) // 128 AS chunk_no, id AS doc_id, tf::BIGINT AS tf, array_to_string(positions, ',') AS positions FROM p JOIN ids ON ext_id = p.doc_id WHERE term IN ('tion', 'en', 'ering', 're')"),
    ),
    "chunk_round_trip_all": (
        chunk_round_trip_all,
        _sql("SELECT term, (row_number() OVER (PARTITION BY term ORDER BY p.doc_id) - 1) // 128 AS chunk_no, id AS doc_id, tf::BIGINT AS tf, array_to_string(positions, ',') AS positions FROM p JOIN ids ON ext_id = p.doc_id"),
    ),
    "posting_merge": (posting_merge, _sql("SELECT term, doc_id, tf FROM p")),
    "boolean_pairwise": (boolean_pairwise, _sql("SELECT doc_id FROM p WHERE term IN ('tion', 'ering') GROUP BY doc_id HAVING count(*) = 2")),
    "transliterated_terms": (transliterated_terms, _sql("SELECT term, count(*) AS n FROM t GROUP BY term").replace("text, '[", f"translate(text, '{text._MARKED}', '{text._PLAIN}'), '[")),
    "codec_varbyte": (_codec("varbyte", True), _CODEC_SQL),
    "codec_simple9": (_codec("simple9", True), _CODEC_SQL),
    "codec_simple16": (_codec("simple16", True), _CODEC_SQL),
    "codec_pfordelta": (_codec("pfordelta", False), _CODEC_SQL),
    "codec_rice": (_codec("rice", True), _CODEC_SQL),
}
