"""python -m quern.cli CONFIG: commands index, load, save, query, terms, metadata, help, quit."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.codecs import DEFAULT, check_codec
from quern.operators.retrieval import check_mode
from quern.plans.index import Index
from quern.sources.articles import articles, read_lines

HELP = "index | load | save FOLDER | query WORDS | terms | metadata | help | quit"


@dataclass
class Config:
    dataset_dir: str = "dataset"
    index_dir: str = "index"
    codec: str = DEFAULT
    mode: str = "wand"

    @classmethod
    def load(cls, path: str) -> Config:
        """From JSON; a file that can't be read gives the defaults, an unknown codec or mode is an error."""
        try:
            with open(path, encoding="utf-8") as f:
                given = json.load(f)
            config = cls(**{k.name: str(given[k.name]) for k in fields(cls) if k.name in given})
        except (OSError, ValueError, TypeError):
            config = cls()
        check_codec(config.codec)
        check_mode(config.mode)
        return config


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each article: its url, a digest of title and text, and a number among
    those that are alike. Articles may share a url."""
    docs = docs.withColumn("key", F.concat_ws("\n", "url", F.sha2(F.to_json(F.struct("title", "text")), 256)))
    alike = Window.partitionBy("key").orderBy(F.lit(0))
    return docs.withColumn("key", F.concat_ws("\n", "key", F.row_number().over(alike)))


def run(spark: SparkSession, config: Config, lines: Iterable[str]) -> Iterable[str]:
    """What each command answers."""
    index: Index | None = None
    for line in lines:
        command, _, rest = line.strip().partition(" ")
        if not command:
            continue
        if command in ("quit", "exit"):
            return
        if command == "help":
            yield HELP
        elif command == "index":
            if not os.path.isdir(config.dataset_dir):
                yield f"no folder {config.dataset_dir}"
                continue
            docs = keyed(articles(read_lines(spark, config.dataset_dir)))
            index = Index.build(spark, docs, config.index_dir, key="key", title="title", url="url", codec=config.codec)
            yield f"indexed {index.table('docs').count()} documents"
        elif command == "load":
            index = Index.load(spark, config.index_dir)
            yield f"loaded {config.index_dir}"
        elif command not in ("save", "query", "terms", "metadata"):
            yield f"no command {command}; {HELP}"
        elif index is None:
            yield "no index yet: index or load"
        elif command == "save":
            index.save(rest or config.index_dir)
            yield "saved"
        elif command == "query":
            try:
                yield from (f"{r['score']:.6f} {r['title']} {r['url']}" for r in index.hits(rest, mode=config.mode))
            except ValueError as e:
                yield str(e)
        elif command == "terms":
            yield from (r["term"] for r in index.terms().orderBy("term").toLocalIterator())
        else:
            yield json.dumps(index.metadata().first().asDict() | {"dataset_dir": config.dataset_dir}, default=str)


if __name__ == "__main__":
    session = SparkSession.builder.appName("quern").getOrCreate()
    for answer in run(session, Config.load(sys.argv[1] if len(sys.argv) > 1 else "config.json"), sys.stdin):
        print(answer, flush=True)
