"""Articles from JSON lines and from wiki dumps, and the sink of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import once

ARTICLE = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "text", "title")])
PARAGRAPHS = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("text", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("id", T.StringType()), T.StructField("title", T.StringType())]
)
CORRUPT = "_corrupt_record"
#: Sections that hold no prose.
SECTIONS = ("See also", "Further reading", "Notes", "References", "External links", "Bibliography")
BATCH = 500


def read_lines(spark: SparkSession, path: str, schema: T.StructType = ARTICLE, pattern: str = "*.{zst,zstd,json,jsonl,gz}") -> DataFrame:
    """All lines of all files under path, with CORRUPT for those that are no JSON. The last line needs no
    newline; other keys are ignored. Files in any depth of folders."""
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(path)


def articles(lines: DataFrame) -> DataFrame:
    """Lines that are JSON and have all of url, text and title."""
    return lines.filter(F.col(CORRUPT).isNull() & F.col("url").isNotNull() & F.col("text").isNotNull() & F.col("title").isNotNull()).drop(CORRUPT)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a wiki dump: id, ns, title, redirect, revision (array of structs with timestamp and text)."""
    revision = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("ns", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("redirect", T.StringType()), T.StructField("revision", T.ArrayType(revision))]
    )
    return spark.read.schema(schema).format("xml").option("rowTag", "page").load(path)


def is_article(namespace: Column, redirect: Column) -> Column:
    return (namespace == 0) & redirect.isNull()


def last_revision(revisions: Column) -> Column:
    """The text of the last revision; null if it has none."""
    return F.nullif(F.element_at(revisions, -1)["text"], F.lit(""))


def drop_sections(text: Column) -> Column:
    """Without the sections in SECTIONS, each up to the next heading of its level or a higher one."""
    names = "|".join(SECTIONS)
    any_ = text.rlike(rf"(?:^|\n)=+[ \t]*(?:{names})")  # one search, where six find nothing
    out = text
    for level in range(1, 7):
        mark, up = "=" * level, f"={{1,{level}}}"
        out = F.regexp_replace(out, rf"(?s)(?:^|\n){mark}[ \t]*(?:{names})[ \t]*{mark}[ \t]*(?:\n.*?)?(?=\n{up}[^=\n][^\n]*=[ \t]*(?:\n|\z)|\z)", "")
    return F.when(any_, out).otherwise(text)


def drop_templates(text: Column) -> Column:
    """Without templates, innermost first, until none is left.

    A template goes in a turn after those in it, so the deepest nesting of braces bounds the turns; those
    after nothing changes cost nothing.
    """
    braces = F.regexp_extract_all(text, F.lit(r"([{}])"), F.lit(1))
    depth = F.aggregate(
        braces,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: F.struct(F.greatest(F.lit(0), s["now"] + F.when(c == "{", 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c == "{", 1).otherwise(-1)).alias("most")),
        lambda s: s["most"],
    )
    bare = F.aggregate(
        F.sequence(F.lit(0), depth),
        F.struct(F.lit(None).cast("string").alias("was"), text.alias("text")),
        lambda s, _: F.when(s["was"] == s["text"], s).otherwise(F.struct(s["text"].alias("was"), F.regexp_replace(s["text"], r"\{\{[^{}]*\}\}", "").alias("text"))),
        lambda s: s["text"],
    )
    return F.when(text.contains("{{"), bare).otherwise(text)


def drop_category_links(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\[Category:[^\]]*\]\]", "")


def categories(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[Category:([^\]|]*)[^\]]*\]\]"), F.lit(1)), F.trim)


def strip_markup(text: Column) -> Column:
    """Wiki text as plain text: no comments, references, templates, tags, link targets or emphasis."""
    out = F.regexp_replace(text, r"(?s)<!--.*?-->|<ref[^>]*/>|<ref[^>]*>.*?</ref>", "")
    out = drop_templates(out)
    out = F.regexp_replace(out, r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\[https?://[^ \]]*[ ]?([^\]]*)\]", "$1")
    out = F.regexp_replace(out, r"<[^>]*>|'{2,5}", "")
    out = F.regexp_replace(out, r"(?m)^=+[ \t]*(.*?)[ \t]*=+[ \t]*$", "$1")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    """Newlines as blanks, without double quotes."""
    return F.translate(text, '\n"', " ")


def clean_wiki_text(text: Column) -> Column:
    return one_line(strip_markup(drop_category_links(drop_sections(text))))


def page_url(page_id: Column, base: str) -> Column:
    return F.concat(F.lit(base), page_id.cast("string"))


def sanitize_title(title: Column) -> Column:
    """A title as a file name: characters that file systems refuse and white space as _, 200 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(title, r'[\\/*?:"<>|]', "_"), r"\s+", "_"), 1, 200)


def dump_articles(pages: DataFrame, base: str) -> DataFrame:
    """id, url, text, title of a dump's articles, cleaned; those without text are dropped."""
    rows = pages.filter(is_article(F.col("ns"), F.col("redirect"))).withColumn("_text", last_revision(F.col("revision"))).filter(F.col("_text").isNotNull())
    rows = rows.select("id", page_url(F.col("id"), base).alias("url"), once(clean_wiki_text(F.col("_text"))).alias("text"), "title")
    return rows.filter(F.col("text") != "")


def write_batches(rows: DataFrame, path: str, format: str = "parquet", compression: str = "zstd", batch: int = BATCH) -> None:
    """Files of at most `batch` rows each. JSON lines can be had with gzip, the JSON writer has no zstd."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", batch).option("compression", compression if format == "parquet" else "gzip").format(format).save(path)
