"""Ranked and Boolean retrieval over postings with scores.

All ranked modes give the exact best documents. They differ in how many they give by default and in
whether a document with a score of 0 or less can be one of them, as the pruning methods they are named
after differ in that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.bm25 import rounded

#: mode: default k (None: all), positive scores only.
MODES: dict[str, tuple[int | None, bool]] = {"boolean": (None, False), "wand": (50, True), "bmw": (20, True), "ms": (20, False), "bmms": (20, True)}
#: Query terms that may be broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 100_000


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
    return mode


def weight_of(terms: dict[str, int]) -> Column:
    """How often the query has the row's term."""
    pairs = [x for t, n in sorted(terms.items()) for x in (F.lit(t), F.lit(n))]
    return F.create_map(*pairs)[F.col("term")]


def fetch(posts: DataFrame, terms: dict[str, int]) -> DataFrame:
    """Postings of the terms; the filter reaches the scan, which skips what the sorted term column excludes."""
    return posts.filter(F.col("term").isin(*sorted(terms))) if terms else posts.limit(0)


def totals(posts: DataFrame, terms: dict[str, int]) -> DataFrame:
    """doc_id, score (sum over the query's words, repeats counted)."""
    if not terms:
        return posts.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    return fetch(posts, terms).groupBy("doc_id").agg(F.sum(weight_of(terms) * F.col("score")).alias("score")).select("doc_id", rounded(F.col("score")).alias("score"))


def best(scores: DataFrame, k: int | None, positive: bool) -> DataFrame:
    """Best first; of equal scores the larger identifier."""
    scores = scores.filter("score > 0") if positive else scores
    scores = scores.orderBy(F.desc("score"), F.desc("doc_id"))
    return scores if k is None else scores.limit(k)


def ranked(posts: DataFrame, terms: dict[str, int], mode: str = "wand", k: int | None = None) -> DataFrame:
    default, positive = MODES[check_mode(mode)]
    return best(totals(posts, terms), k or default, positive)


def all_of(posts: DataFrame, terms: dict[str, int]) -> DataFrame:
    """doc_id of documents that have all the terms."""
    found = fetch(posts, terms).groupBy("doc_id").agg(F.count("*").alias("n"))
    return found.filter(F.col("n") == len(terms)).select("doc_id")


def both(posts: DataFrame, left: str, right: str) -> DataFrame:
    """doc_id of documents that have two terms."""
    at = lambda t: posts.filter(F.col("term") == t).select("doc_id")
    return at(left).join(at(right), "doc_id", "left_semi")


def any_of(posts: DataFrame, terms: dict[str, int]) -> DataFrame:
    return fetch(posts, terms).select("doc_id").distinct()


def none_of(docs: DataFrame, posts: DataFrame, terms: dict[str, int]) -> DataFrame:
    """doc_id of documents that have none of the terms."""
    return docs.select("doc_id").join(any_of(posts, terms), "doc_id", "left_anti")


def ranked_many(posts: DataFrame, queries: DataFrame, mode: str = "wand", k: int | None = None) -> DataFrame:
    """queries: query_id, term, qtf. query_id, rank, doc_id, score of each query's best documents."""
    default, positive = MODES[check_mode(mode)]
    few = queries.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    joined = posts.join(F.broadcast(queries) if few else queries, "term")
    scores = joined.groupBy("query_id", "doc_id").agg(rounded(F.sum(F.col("qtf") * F.col("score"))).alias("score"))
    scores = scores.filter("score > 0") if positive else scores
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    out = scores.withColumn("rank", F.row_number().over(order))
    limit = k or default
    return (out.filter(F.col("rank") <= limit) if limit else out).select("query_id", "rank", "doc_id", "score")


def pruned(posts: DataFrame, bounds: DataFrame, terms: dict[str, int], mode: str = "bmw", k: int | None = None, seeds: int = 8) -> DataFrame:
    """The same answer as ranked(), reading only chunks that can hold a document of it.

    A chunk's bound is its best score plus the best of each other term. Documents of the few chunks with
    the highest bounds are scored in full; the k-th best of them is a threshold, and chunks with a lower
    bound are left out. Chunks of a term that only lowers scores are always read, for a sum without it
    would be too high. The driver sees bounds of chunks that pass a filter on term, and no postings.
    """
    default, positive = MODES[check_mode(mode)]
    limit = k or default
    if not terms or limit is None:
        return ranked(posts, terms, mode, k)
    chunks = bounds.filter(F.col("term").isin(*sorted(terms)))
    most = {r["term"]: r["m"] * terms[r["term"]] for r in chunks.groupBy("term").agg(F.max("max_score").alias("m")).collect()}
    if not most:
        return ranked(posts, terms, mode, k)
    above = sum(max(0.0, m) for m in most.values())
    others = F.create_map(*(x for t, m in sorted(most.items()) for x in (F.lit(t), F.lit(above - max(0.0, m)))))
    chunks = chunks.withColumn("bound", weight_of(terms) * F.col("max_score") + others[F.col("term")])
    lead = chunks.orderBy(F.desc("bound"), "term", "chunk_no").limit(seeds).select("term", "chunk_no")
    found = fetch(posts, terms)
    docs = found.join(F.broadcast(lead), ["term", "chunk_no"], "left_semi").select("doc_id").distinct()
    top = totals(found.join(docs, "doc_id", "left_semi"), terms).orderBy(F.desc("score")).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("t")).first()
    if top["n"] < limit:
        return ranked(posts, terms, mode, k)
    # Scores are rounded to 6 places, so a document just under the threshold may round up to it.
    keep = (F.col("bound") >= top["t"] - 1e-6) | F.col("term").isin(*[t for t, m in most.items() if m < 0])
    kept = found.join(chunks.filter(keep).select("term", "chunk_no"), ["term", "chunk_no"], "left_semi")
    return best(totals(kept, terms).filter(F.col("score") >= top["t"]), limit, positive)


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def phrase(posts: DataFrame, words: list[tuple[str, int]]) -> DataFrame:
    """doc_id, n: documents with the words at these distances (term, offset from the first), and how often."""
    out: DataFrame | None = None
    for i, (term, offset) in enumerate(words):
        at = posts.filter(F.col("term") == term).select("doc_id", _shifted(F.col("positions"), offset).alias(f"p{i}"))
        out = at if out is None else out.join(at, "doc_id")
    both = F.col("p0")
    for i in range(1, len(words)):
        both = F.array_intersect(both, F.col(f"p{i}"))
    return out.select("doc_id", F.size(both).cast("long").alias("n")).filter("n > 0")
