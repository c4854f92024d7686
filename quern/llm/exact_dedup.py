"""Exact deduplication by a tree of merges of sorted digest runs.

Each map partition sorts its entries, one for each text, into a run. A run travels as chunks, each a row with
the sorted entries of one range of digests as bytes and the least of them as its head; an exchange moves
chunks and never looks into them. In each round the runs of FAN neighbours meet, range by range; a task reads
the chunks of its runs in order of their heads and merges as it goes: all entries before the next head are
final. So runs stay sorted on their way, nothing is sorted again, and a task holds the open chunks of the
runs it merges. Every merge keeps for each text the identifier that stays and the number of rows; a text that a
third of all rows share is one entry of a run from the first level on. FAN is above 2, for a tree of
pairs would send the digests round three times as often.

An entry's identity is verified at each level: SHA-256, number of bytes and an independent 64-bit
hash must all agree, else entries stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, skew_join

#: Runs that meet in one round; the tree has log(partitions, FAN) rounds.
FAN = 4
#: Entries of a chunk, and rows that one run is made of.
CHUNK, RUN = 20_000, 1 << 20

_CHUNK = "run long, shard int, head binary, keys binary, best binary, known binary, n_rows binary"
_ENTRY = "digest binary, n_bytes long, check long, best long, n_rows long"


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, digest, n_bytes, check of every row; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("_t")).select(
        "doc_id",
        F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("digest"),
        F.octet_length("_t").cast("long").alias("n_bytes"),
        F.xxhash64("_t").alias("check"),
    )


class Entries:
    """Sorted entries: keys, the identifier that stays so far, whether there is one, and the number of rows. A key is
    digest, number of bytes and check, one after the other; all are of one length."""

    def __init__(self, keys: np.ndarray, best: np.ndarray, known: np.ndarray, n_rows: np.ndarray) -> None:
        self.keys, self.best, self.known, self.n_rows = keys, best, known, n_rows

    def __len__(self) -> int:
        return len(self.keys)

    def cut(self, first: int, last: int) -> Entries:
        return Entries(*(x[first:last] for x in (self.keys, self.best, self.known, self.n_rows)))

    @staticmethod
    def merged(parts: list[Entries], largest: bool) -> Entries:
        """One entry for each key. The parts stand one after the other, so the sort, which looks for ascending runs
        and merges them, does nothing else."""
        keys, best, known, n_rows = (np.concatenate(x) for x in zip(*((p.keys, p.best, p.known, p.n_rows) for p in parts)))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        lead = np.ones(len(keys), bool)
        lead[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(lead)
        unknown = np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max
        best = np.where(known, best, unknown)[order]
        return Entries(keys[at], (np.maximum if largest else np.minimum).reduceat(best, at), np.logical_or.reduceat(known[order], at), np.add.reduceat(n_rows[order], at))

    def rows(self, run: int, shard: int) -> Iterator[dict]:
        for i in range(0, len(self), CHUNK):
            x = self.cut(i, i + CHUNK)
            yield {"run": run, "shard": shard, "head": x.keys[:1].tobytes(), "keys": x.keys.tobytes(), "best": x.best.tobytes(), "known": x.known.tobytes(), "n_rows": x.n_rows.tobytes()}

    @classmethod
    def read(cls, row: dict) -> Entries:
        kinds = (("keys", f"S{len(row['head'])}"), ("best", np.int64), ("known", bool), ("n_rows", np.int64))
        return cls(*(np.frombuffer(row[c], kind) for c, kind in kinds))

    def table(self) -> pa.RecordBatch:
        size = self.keys.itemsize
        raw = np.ascontiguousarray(self.keys).view(np.uint8).reshape(-1, size)
        number = lambda i: np.ascontiguousarray(raw[:, i : i + 8]).view(">u8").reshape(-1).astype(np.uint64).view(np.int64)
        digest = pa.array(np.ascontiguousarray(raw[:, : size - 16]).view(f"V{size - 16}").reshape(-1).tolist(), pa.binary())
        columns = [digest, pa.array(number(size - 16)), pa.array(number(size - 8)), pa.array(self.best, mask=~self.known), pa.array(self.n_rows)]
        return pa.RecordBatch.from_arrays(columns, names=["digest", "n_bytes", "check", "best", "n_rows"])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"run": pa.int64(), "shard": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.binary())) for c in rows[0]], names=list(rows[0]))


def _runs(shards: int, largest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one partition, with its number as run -> chunks of its run. A long partition makes more runs, which meet
    in the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []

        def flush() -> Iterator[pa.RecordBatch]:
            e = Entries.merged(held, largest)
            top = np.ascontiguousarray(e.keys).view(np.uint8).reshape(len(e), -1)[:, :4].astype(np.int64) @ (1 << np.array([24, 16, 8, 0]))
            edge = np.searchsorted(top * shards >> 32, np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(edge)).tolist():
                yield from (_batch([r]) for r in e.cut(edge[s], edge[s + 1]).rows(number, s))

        number = 0
        for b in batches:
            if not len(b):
                continue
            number = b.column("run")[0].as_py()
            digest = np.frombuffer(b"".join(b.column("digest").to_pylist()), np.uint8).reshape(len(b), -1)
            numbers = [b.column(c).to_numpy().view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8) for c in ("n_bytes", "check")]
            key = np.concatenate([digest, *numbers], 1)
            best = b.column("doc_id")
            held.append(Entries(key.view(f"S{key.shape[1]}").reshape(-1), best.fill_null(0).to_numpy(), best.is_valid().to_numpy(zero_copy_only=False), np.ones(len(b), np.int64)))
            if sum(map(len, held)) >= RUN:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    return run


def merge(chunks: Iterator[dict], largest: bool) -> Iterator[tuple[int, int, Entries]]:
    """Multiway merge: chunks come by (run, shard) and, in each, by head. (run, shard, entries) in order; entries that
    are before the next head can't change any more."""
    held: list[Entries] = []
    at: tuple[int, int] | None = None
    for row in chunks:
        if at is not None and (row["run"], row["shard"]) != at:
            yield *at, Entries.merged(held, largest)
            held = []
        at = (row["run"], row["shard"])
        head = np.frombuffer(row["head"], f"S{len(row['head'])}")[0]
        cuts = [int(np.searchsorted(e.keys, head)) for e in held]
        done = [e.cut(0, c) for e, c in zip(held, cuts) if c]
        if sum(map(len, done)) >= CHUNK:  # fewer wait for more
            yield *at, Entries.merged(done, largest)
            held = [e.cut(c, len(e)) for e, c in zip(held, cuts) if c < len(e)]
        held.append(Entries.read(row))
    if held:
        yield *at, Entries.merged(held, largest)


def _merged(largest: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of FAN runs -> those of one, or entries after the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, shard, e in merge((r for b in batches for r in b.to_pylist()), largest):
            if last:
                yield from (e.cut(i, i + CHUNK).table() for i in range(0, len(e), CHUNK))
            else:
                yield from (_batch([r]) for r in e.rows(number, shard))

    return run


def merge_tree(rows: DataFrame, keep: str = "smallest", shards: int | None = None) -> DataFrame:
    """rows: digests(). One row for each text: digest, n_bytes, check, best (the identifier that
    stays), n_rows. A null identifier never stays while there is another."""
    largest = keep == "largest"
    shards = shards or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sources = max(1, rows.rdd.getNumPartitions())
    level = rows.withColumn("run", F.spark_partition_id().cast("long")).mapInArrow(_runs(shards, largest), _CHUNK)
    while True:
        sources = -(-sources // FAN)
        last = sources <= 1
        level = level.withColumn("run", F.floor(F.col("run") / FAN)).repartition("run", "shard")
        level = level.sortWithinPartitions("run", "shard", "head").mapInArrow(_merged(largest, last), _ENTRY if last else _CHUNK)
        if last:
            return level


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts, the row with the
    smallest (keep="largest": largest) identifier stays. Repeated rows with the identifier that stays
    are all marked kept: they are one document. If all identifiers of a text are null, keep_id is null
    and its rows are kept, since nothing tells which to drop. Of a text of any length only its digest
    travels. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = materialize(digests(docs, text, doc_id), "digest-rows")
    found = skew_join(rows, merge_tree(rows, keep), ["digest", "n_bytes", "check"], "n_rows")
    kept: Column = F.col("best").isNull() | F.coalesce(F.col("doc_id") == F.col("best"), F.lit(False))
    return found.select("doc_id", F.col("best").alias("keep_id"), F.col("n_rows").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
