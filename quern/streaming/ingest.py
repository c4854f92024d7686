"""Articles that keep arriving: a stream of files into a document table, and the index built anew from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import doc_length
from quern.sources.articles import ARTICLE, CORRUPT


def watch(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of well-formed articles from JSON line files as they appear under path."""
    schema = T.StructType([*ARTICLE.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).json(path)
    return lines.filter(F.col(CORRUPT).isNull() & F.col("text").isNotNull() & F.col("url").isNotNull() & F.col("title").isNotNull()).drop(CORRUPT)


def collect_articles(stream: DataFrame, table: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends articles with a token to the Parquet table, once each: a batch that is run again overwrites
    its own folder. after: gets each batch when it is stored."""

    def store(batch: DataFrame, number: int) -> None:
        batch.filter(doc_length(F.col("text")) > 0).write.mode("overwrite").parquet(f"{table}/batch={number}")
        if after:
            after(batch, number)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
