"""Documents to training tokens: toxic ones go, copies go, near copies go, sources are mixed, text is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Columns of docs may
have any names besides doc_id, text and source; stages work under names of their own and give the columns
back as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from quern.llm.common import discard, materialize

_Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that can't clash, and the new name of each column that a stage needs."""
    new = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*new), {c: n for c, n in zip(docs.columns, new) if c in ("doc_id", "text", "source")}


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds _ref, a 256-bit digest of the whole row: rows that share it are alike in all columns."""
    parts = []
    for f in docs.schema.fields:
        value = F.base64(F.col(f.name)) if f.dataType.typeName() == "binary" else F.col(f.name).cast("string")
        # With its length before it, so that no two rows give the same string.
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return docs.withColumn("_ref", F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256)))


def _take(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs (keyed) that wanted (_ref, copies, alike) asks for, so many times. One row for each _ref in wanted;
    at most alike rows of docs have it, which the caller knows from tables without texts."""
    if docs.columns[-1] != "_ref":
        raise ValueError("no _ref")
    # Rows that are alike are seldom, but must be told from copies that are asked for.
    if wanted.filter("alike > 1").limit(1).count():
        docs = docs.dropDuplicates(["_ref"])
    return docs.join(wanted.drop("alike"), "_ref").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns[:-1])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under the threshold. A null or empty text has score 0 and is kept; a very long one has
    the score of its worst window. Repeated rows score alike, so all go or all stay. Without labels of both
    classes all texts with words score alike. An empty table gives no rows; other columns stay as they are."""
    model = toxicity.fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, name = _named(docs)
    return toxicity.score_docs(rows, model, name["text"]).filter(F.col("_score") < toxicity.THRESHOLD).drop("_score").toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest identifier. Of several with that identifier one
    stays, one whose text isn't null before others. Null texts count as empty; a text whose identifiers are all null
    stays once. A very long text is compared whole. An empty table gives no rows; other columns stay as they are."""
    rows, name = _named(docs)
    marked = exact_dedup.exact_dedup(docs, keep="largest").filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    # A null text and an empty one are equal, and may have the same identifier: the empty one stays.
    digest = F.sha2(F.coalesce(F.col(name["text"]), F.lit("")).cast("binary"), 256)
    ids = _keyed(rows).select("_ref", F.col(name["doc_id"]).cast("long").alias("_own"), digest.alias("_sha"), F.col(name["text"]).isNull().alias("_null"))
    stay = ids.join(marked.distinct(), (ids["_sha"] == marked["_sha"]) & ids["_own"].eqNullSafe(marked["_id"])).select("_ref", "_null", ids["_sha"], "_own")
    wanted = stay.groupBy("_sha", "_own").agg(F.min_by("_ref", F.struct("_null", "_ref")).alias("_ref"), F.count("*").alias("alike")).select("_ref", F.lit(1).alias("copies"), "alike")
    return _take(_keyed(rows), materialize(wanted, "kept")).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least identifier; different texts that share it all
    stay, rows that are alike become one. A null or empty text is like no other and stays; a class without
    identifiers stays whole. A very long text is compared whole. An empty table gives no rows; other columns
    stay as they are."""
    rows, name = _named(docs)
    found = near_dedup.near_duplicates(_keyed(rows), text=name["text"], doc_id=name["doc_id"], ref="_ref")
    wanted = found.filter("kept").groupBy(F.col("ref").alias("_ref")).agg(F.lit(1).alias("copies"), F.count("*").alias("alike"))
    return _take(_keyed(rows), materialize(wanted, "kept")).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents so often as the mix takes them. Null and empty texts have no words and may be taken; a very long one
    is a document like others. Rows without a source are the last source. Repeated rows are taken in their share
    of all. An empty table gives no rows; other columns stay as they are."""
    rows, name = _named(docs)
    found = mixing.mix_sources(_keyed(rows), text=name["text"], doc_id=name["doc_id"], source=name["source"], ref="_ref")
    wanted = found.groupBy("ref").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("alike")).filter("copies > 0").withColumnRenamed("ref", "_ref")
    return _take(_keyed(rows), materialize(wanted, "copies")).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each document, repeated rows too. A null or empty text has no
    tokens; a very long one all of its own. An empty table gives no rows; other columns are left behind."""
    return bpe.encode_docs(docs)


STAGES: list[tuple[str, _Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]
#: Models, graphs and samples can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; a stage's table goes when the next is written."""
    docs = last = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, last = materialize(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        if name != STAGES[0][0]:
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
