"""The index: tables of documents, postings, terms, block bounds and statistics."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.bm25 import BM25
from quern.functions.codecs import DEFAULT, check_codec
from quern.functions.text import count_terms, placed_tokens, tokenize
from quern.operators import postings as P
from quern.operators import retrieval as R
from quern.operators.fuzzy import similar_terms
from quern.operators.ids import dense_ids, numbered_places
from quern.plans.workspace import workspace, write_table

#: Remembered queries, and rows of each of them.
CACHED_QUERIES, HITS = 10_000, 50
VERSION = 1
TABLES = ("docs", "postings", "terms", "block_max", "meta")


def query_terms(spark: SparkSession, text: str) -> list[tuple[str, int]]:
    """(term, position) of a query, by the documents' tokenizer. A blank query is an error."""
    if not text.strip():
        raise ValueError("blank query")
    row = spark.range(1).select(F.lit(text).alias("text"))
    return [(r["term"], r["pos"]) for r in tokenize(row).orderBy("pos").collect()]


@dataclass
class Index:
    """Tables under a folder. Results are cached by the index's stamp, so a rebuilt one starts anew."""

    spark: SparkSession
    path: str
    stamp: str

    def __post_init__(self) -> None:
        self._cache: OrderedDict[tuple, list] = OrderedDict()
        self._known: dict[str, DataFrame] = {}

    @classmethod
    def build(cls, spark: SparkSession, docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", title: str | None = None, url: str | None = None, model: BM25 = BM25(), codec: str = DEFAULT, chunk: int = P.CHUNK) -> Index:
        """Indexes docs (key: a column without repeats that orders them) and writes the tables under path, over
        any index there.

        Documents without a token get no identifier. Texts are shuffled once, to be numbered in order of their key; their terms are counted in the
        row, once. Postings are shuffled once, to be range-partitioned and sorted by term, so a search reads the
        row groups of its terms only.
        """
        check_codec(codec)
        path = path or f"{workspace(spark)}/index-{uuid.uuid4().hex}"
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}", compression="zstd")
        get = lambda name: spark.read.parquet(f"{path}/{name}")
        rows = docs.select(F.col(key).alias("ext_id"), F.col(text).alias("text"), (F.col(title) if title else F.concat(F.lit("doc-"), F.col(key))).alias("title"), (F.col(url) if url else F.lit("")).alias("url"))
        # By ranges of the key, so that a document's number is its place. A table of few row groups is spread, too, for its texts
        # are split into words there.
        parts = max(spark.sparkContext.defaultParallelism, 2 * rows.rdd.getNumPartitions())
        rows = rows.repartitionByRange(parts, "ext_id").sortWithinPartitions("ext_id")
        rows = count_terms(rows.select("ext_id", "title", "url", placed_tokens(F.col("text")).alias("tokens"))).filter("doc_len > 0")
        known = numbered_places(write_table(rows.withColumn("_place", F.monotonically_increasing_id()), "counted", "zstd"), "doc_id")
        put(known.select("doc_id", "ext_id", "title", "url", "doc_len"), "docs")
        ids = get("docs").select("ext_id", "doc_id", "doc_len")
        if ids.groupBy("ext_id").count().filter("count > 1").limit(1).count():
            raise ValueError(f"{key} isn't unique")
        stats = P.collection(ids)
        stamp = uuid.uuid4().hex
        put(stats.select("n_docs", "n_tokens", "avgdl", F.lit(model.k1).alias("k1"), F.lit(model.b).alias("b"), F.lit(codec).alias("codec"), F.lit(VERSION).alias("version"), F.lit(stamp).alias("stamp")).coalesce(1), "meta")
        stats = get("meta").select("n_docs", "n_tokens", "avgdl")
        posts = P.numbered(P.postings_of(known, "doc_id", "doc_len").drop("tf")).withColumn("tf", F.size("positions"))
        posts = P.with_scores(posts, stats, model).withColumn("chunk_no", P.chunk_of(F.col("rn"), chunk))
        put(posts.select("term", "doc_id", "tf", "positions", "score", "chunk_no"), "postings")
        put(P.block_bounds(get("postings").drop("positions")), "block_max")
        put(dense_ids(P.term_table(get("block_max"), stats), "term", name="term_id").select("term_id", "term", "df", "idf", "max_score"), "terms")
        return cls(spark, path, stamp)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta["version"] != VERSION:
            raise ValueError(f"an index of version {meta['version']}")
        return cls(spark, path, meta["stamp"])

    def save(self, path: str) -> Index:
        """Copies the tables to another folder."""
        for name in TABLES:
            self.table(name).write.mode("overwrite").parquet(f"{path}/{name}")
        return Index(self.spark, path, self.stamp)

    def table(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self._known[name]

    def persist(self) -> Index:
        """Keeps the postings in memory for many searches."""
        self._known["postings"] = self.table("postings").persist()
        return self

    def terms(self, longest: int = 20) -> DataFrame:
        return self.table("terms").filter(F.length("term") <= longest)

    def metadata(self) -> DataFrame:
        """One row: documents, terms, chunks, size in GB, statistics, codec, folder. The codec is a name that goes
        with the index; postings_encoded says whether its postings are stored with it, and they aren't."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.path)
        size = files.agg((F.coalesce(F.sum("length"), F.lit(0)) / 1e9).alias("size_gb"))
        terms = self.table("terms").agg(F.count("*").alias("n_terms"), F.max(F.length("term")).alias("max_length"))
        chunks = self.table("block_max").agg(F.count("*").alias("n_chunks"))
        return self.table("meta").crossJoin(terms).crossJoin(chunks).crossJoin(size).withColumn("index_dir", F.lit(self.path)).withColumn("postings_encoded", F.lit(False))

    def _terms_of(self, text: str, strict: bool) -> dict[str, int]:
        counts: dict[str, int] = {}
        for term, _ in query_terms(self.spark, text):
            counts[term] = counts.get(term, 0) + 1
        if not counts:
            return counts
        known = {r["term"] for r in self.table("terms").filter(F.col("term").isin(*counts)).select("term").collect()}
        if strict and len(known) < len(counts):
            raise ValueError(f"unknown terms: {', '.join(sorted(counts.keys() - known))}")
        return {t: n for t, n in counts.items() if t in known}

    def _described(self, found: DataFrame) -> DataFrame:
        """With the documents' metadata; best first."""
        return found.join(self.table("docs"), "doc_id").select("doc_id", "ext_id", "title", "url", "doc_len", "score").orderBy(F.desc("score"), F.desc("doc_id"))

    def search(self, text: str, k: int | None = None, mode: str = "wand", strict: bool = False, prune: bool = False) -> DataFrame:
        """doc_id, ext_id, title, url, doc_len, score of the best documents. Unknown words don't count
        (strict: are an error); mode boolean gives all documents with all words, with score 0."""
        R.check_mode(mode)
        terms = self._terms_of(text, strict)
        posts = self.table("postings")
        if mode == "boolean":
            found = R.all_of(posts, terms).withColumn("score", F.lit(0.0))
            found = found if k is None else found.orderBy("doc_id").limit(k)
            return found.join(self.table("docs"), "doc_id").select("doc_id", "ext_id", "title", "url", "doc_len", "score").orderBy("doc_id")
        found = R.pruned(posts, self.table("block_max"), terms, mode, k) if prune else R.ranked(posts, terms, mode, k)
        return self._described(found)

    def hits(self, text: str, k: int | None = None, mode: str = "wand") -> list:
        """search(), collected and remembered: rows of the k best documents, by default as many as the mode gives,
        and of mode boolean the first HITS."""
        k = k or R.MODES[R.check_mode(mode)][0] or HITS
        key = (self.stamp, text, k, mode)
        if key in self._cache:
            self._cache.move_to_end(key)
            return self._cache[key]
        self._cache[key] = rows = self.search(text, k, mode).collect()
        if len(self._cache) > CACHED_QUERIES:
            self._cache.popitem(last=False)
        return rows

    def search_many(self, queries: DataFrame, k: int | None = None, mode: str = "wand") -> DataFrame:
        """queries: query_id, text. query_id, rank, doc_id, score."""
        terms = tokenize(queries, "text", "query_id").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        return R.ranked_many(self.table("postings"), terms, mode, k)

    def any_of(self, text: str) -> DataFrame:
        return R.any_of(self.table("postings"), self._terms_of(text, False))

    def none_of(self, text: str) -> DataFrame:
        return R.none_of(self.table("docs"), self.table("postings"), self._terms_of(text, False))

    def phrase(self, text: str) -> DataFrame:
        words = query_terms(self.spark, text)
        return R.phrase(self.table("postings"), [(t, p - words[0][1]) for t, p in words])

    def similar(self, word: str, distance: int = 1) -> DataFrame:
        return similar_terms(self.table("terms").select("term"), word, distance)
