"""Postings as compressed chunks: one row for up to CHUNK documents of a term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import codecs
from quern.operators.postings import in_parts


def encode_chunks(posts: DataFrame, codec: str = codecs.DEFAULT, doc_id: str = "doc_id") -> DataFrame:
    """term, chunk_no, n, last_doc, max_score, codec, and doc_ids (by gaps), tfs, positions (all documents' one
    after the other, with tfs to cut them) as bytes. posts has chunk_no, so a group has few rows."""
    row = F.struct(F.col(doc_id).alias("d"), F.col("tf"), F.col("positions"))
    # All rows of a chunk meet before they are collected: collecting in each task first would sort all that it reads.
    rows = in_parts(posts, "term", "chunk_no").groupBy("term", "chunk_no").agg(F.sort_array(F.collect_list(row)).alias("r"), F.max("score").alias("max_score"))
    return rows.select(
        "term", "chunk_no", F.size("r").alias("n"), F.element_at("r", -1)["d"].alias("last_doc"), "max_score", F.lit(codecs.check_codec(codec)).alias("codec"),
        codecs.encode(F.col("r.d"), codec, True).alias("doc_ids"), codecs.encode(F.col("r.tf"), codec).alias("tfs"), codecs.encode(F.flatten("r.positions"), codec).alias("positions"),
    )


def decode_chunks(chunks: DataFrame, codec: str = codecs.DEFAULT) -> DataFrame:
    """term, chunk_no, doc_id, tf, positions. Only columns that are asked for are decoded."""
    lists = chunks.select("term", "chunk_no", codecs.decode(F.col("doc_ids"), codec, True).alias("d"), codecs.decode(F.col("tfs"), codec).alias("tf"), codecs.decode(F.col("positions"), codec).alias("p"))
    before = codecs.sums_before(F.col("tf"))
    rows = lists.withColumn("before", before).select("term", "chunk_no", "p", F.explode(F.arrays_zip("d", "tf", "before")).alias("z"))
    return rows.select("term", "chunk_no", F.col("z.d").alias("doc_id"), F.col("z.tf").alias("tf"), F.slice("p", F.col("z.before").cast("int") + 1, F.col("z.tf").cast("int")).alias("positions"))
