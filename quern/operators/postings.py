"""From documents to postings, statistics and block bounds.

docs: doc_id (dense, from 1), and text. A document's terms are counted in its row, and only postings are
shuffled. Nothing here collects a term's
postings in one task: what runs over the documents of a term is done by ranges of documents, whose
counts give each range its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.bm25 import BM25, idf
from quern.functions.text import count_terms, doc_length, once, placed_tokens
from quern.plans.workspace import write_table

CHUNK = 128
#: Documents of a range, within which a term's postings are numbered by one task.
RANGE = 1 << 20
#: Terms with more documents than HOT are joined in PARTS parts of them by hash, where their order doesn't matter.
HOT, PARTS = 1 << 20, 64
#: Postings that a task sorts.
SORTED = 1 << 20


def in_parts(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """rows by hash of the keys, in as many partitions as keep each small enough to be sorted in memory, and one for each
    core at least. Spark's own number of partitions doesn't grow with the table, and those it joins are sized as packed bytes."""
    n = rows.count() if n is None else n
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // SORTED)), *keys)


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, doc_len, terms (as count_terms gives them) of each document. Rows that share a doc_id are one document;
    only those are shuffled."""
    rows = docs.select(doc_id, placed_tokens(F.col(text)).alias("tokens"))
    again = docs.groupBy(doc_id).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(doc_id).alias("_id"))
    if again.limit(1).count():
        one = rows.join(again, F.col(doc_id).eqNullSafe(F.col("_id")), "left_anti")
        many = rows.join(again, F.col(doc_id).eqNullSafe(F.col("_id")), "left_semi")
        rows = one.unionByName(many.groupBy(doc_id).agg(F.flatten(F.collect_list("tokens")).alias("tokens")))
    return count_terms(rows)


def postings_of(documents: DataFrame, *keys: str) -> DataFrame:
    """term, keys, tf, positions of documents with terms (as counted() gives them)."""
    rows = documents.select(*keys, F.explode("terms").alias("_t"))
    return rows.select(F.col("_t.term").alias("term"), *keys, F.size("_t.positions").alias("tf"), F.col("_t.positions").alias("positions"))


def postings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """term, doc_id, tf, positions (ascending) of each term in each document."""
    return postings_of(counted(docs, text, doc_id), doc_id)


def lengths(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, doc_len of documents with a token; no shuffle."""
    return docs.select(doc_id, once(doc_length(F.col(text))).alias("doc_len")).filter("doc_len > 0")


def collection(lens: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens, avgdl."""
    return lens.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.col("doc_len").cast("long")), F.lit(0)).alias("n_tokens"), F.avg("doc_len").alias("avgdl"))


def frequencies(posts: DataFrame) -> DataFrame:
    """term, df."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def scored(posts: DataFrame, lens: DataFrame, stats: DataFrame, model: BM25 = BM25(), doc_id: str = "doc_id") -> DataFrame:
    """posts with doc_len, df and score (BM25 of the term in the document)."""
    return with_scores(with_df(posts.join(lens, doc_id), doc_id), stats, model)


def with_df(posts: DataFrame, doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """Adds df. Postings are shuffled once, to meet the term's count; a term that a third of all documents have is no hot
    key, for it meets its count in parts of its documents. The hot terms are at most all postings / hot."""
    sizes = write_table(frequencies(posts), "frequencies")
    total = sizes.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    many = F.broadcast(sizes.filter(F.col("df") > hot).select("term", F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(doc_id), F.lit(PARTS)).cast("int")).otherwise(0)
    rows = posts.join(many, "term", "left").withColumn("_part", part).drop("_hot")
    sizes = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col("df") > hot, PARTS - 1).otherwise(0))))
    return in_parts(rows, "term", "_part", n=total).join(sizes, ["term", "_part"]).drop("_part")


def with_scores(posts: DataFrame, stats: DataFrame, model: BM25 = BM25()) -> DataFrame:
    """posts (with doc_len and df) with score. stats is one row, so it is always broadcast."""
    joined = posts.crossJoin(F.broadcast(stats))
    return joined.withColumn("score", model.score(F.col("n_docs"), F.col("df"), F.col("tf"), F.col("doc_len"), F.col("avgdl"))).drop("n_docs", "n_tokens", "avgdl")


def term_table(bounds: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf, max_score by the bounds of a term's chunks."""
    found = bounds.groupBy("term").agg(F.sum("n").alias("df"), F.max("max_score").alias("max_score"))
    return found.crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"), "max_score")


def numbered(posts: DataFrame, doc_id: str = "doc_id", size: int = RANGE) -> DataFrame:
    """Adds rn: the place of a posting among its term's, from 1, in order of doc_id; and df, the term's postings. Rows are
    range-partitioned and sorted by term and document.

    Postings are shuffled once: a row for each term and range of documents, which says what stands before the
    range, is sorted in front of the range's postings.
    """
    rows = posts.withColumn("_range", F.floor(F.col(doc_id) / size))
    sizes = write_table(rows.groupBy("term", "_range").agg(F.count("*").alias("_n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count("*").alias("heads")).first()
    before = Window.partitionBy("term").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.select("term", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy("term")).alias("df"))
    rows = rows.withColumn("_row", F.lit(1)).unionByName(heads.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(total["n"] + total["heads"]) // SORTED))
    rows = rows.repartitionByRange(parts, "term", "_range").sortWithinPartitions("term", "_range", "_row", doc_id)
    inside = Window.partitionBy("term", "_range").orderBy("_row", doc_id)
    known = [F.first(c).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(c) for c in ("_first", "df")]
    rows = rows.select(*posts.columns, "_row", *known, F.row_number().over(inside).alias("_rank")).filter("_row = 1")
    return rows.select(*posts.columns, "df", (F.col("_first") + F.col("_rank") - 1).alias("rn"))


def chunk_of(rn: Column, chunk: int = CHUNK) -> Column:
    return F.floor((rn - 1) / chunk).cast("long")


def block_bounds(posts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """term, chunk_no, first_doc, last_doc, n, max_score of scored postings with chunk_no."""
    return posts.groupBy("term", "chunk_no").agg(F.min(doc_id).alias("first_doc"), F.max(doc_id).alias("last_doc"), F.count("*").alias("n"), F.max("score").alias("max_score"))


def doc_gaps(posts: DataFrame, doc_id: str = "doc_id", size: int = RANGE) -> DataFrame:
    """term, doc_id, gap: the identifier less the term's one before it; the first counts from 0."""
    rows = in_parts(posts.select("term", doc_id, F.floor(F.col(doc_id) / size).alias("_range")), "term", "_range")
    last = posts.select("term", doc_id, F.floor(F.col(doc_id) / size).alias("_range")).groupBy("term", "_range").agg(F.max(doc_id).alias("_last"))
    last = last.select("term", "_range", F.lag("_last", 1, 0).over(Window.partitionBy("term").orderBy("_range")).alias("_before"))
    inside = Window.partitionBy("term", "_range").orderBy(doc_id)
    rows = rows.withColumn("_lag", F.lag(doc_id).over(inside)).join(last, ["term", "_range"])
    return rows.select("term", doc_id, (F.col(doc_id) - F.coalesce("_lag", "_before")).alias("gap"))


def merge_runs(*runs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Postings of several runs as one, range-partitioned and sorted by term and document. Rows that two
    runs have both stay."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out.repartitionByRange("term", doc_id).sortWithinPartitions("term", doc_id)
