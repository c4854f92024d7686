"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows of equal text) enter, by falling size, the bin with the tightest remaining capacity that
holds them, found in a balanced tree. Groups of one size are alike to the packer, so the driver packs a
histogram: a bin that takes one group of a size is thereby the tightest for the next one of that size, and
is filled with as many as fit at once. This is the packing of all groups one by one, bin for bin. A
corpus of b bytes has at most sqrt(2 * b) distinct sizes, and a few hundred thousand in practice; those, and how
often each occurs, is all that the driver sees. A group finds its bin by its rank among the groups of its size.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import bounded_broadcast, materialize, skew_join

#: Keys of a table that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


class Treap:
    """A balanced tree of (remaining capacity, bin): insert, and take the least entry not below a bound."""

    def __init__(self, seed: int = 7) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self._random = random.Random(seed).random

    @staticmethod
    def _split(node: list | None, key: tuple) -> tuple[list | None, list | None]:
        """Entries below key, the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = Treap._split(node[3], key)
            node[3] = low
            return node, high
        low, high = Treap._split(node[2], key)
        node[2] = high
        return low, node

    @staticmethod
    def _join(low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = Treap._join(low[3], high)
            return low
        high[2] = Treap._join(low, high[2])
        return high

    def insert(self, key: tuple) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self._random(), None, None]), high)

    def take(self, bound: tuple) -> tuple | None:
        """Removes and returns the least entry that isn't below bound."""
        low, high = self._split(self.root, bound)
        if high is None:
            self.root = low
            return None
        if high[2] is None:
            found, high = high[0], high[3]
        else:
            above = high
            while above[2][2] is not None:
                above = above[2]
            found, above[2] = above[2][0], above[2][3]
        self.root = self._join(low, high)
        return found


#: For each size, in falling order: its bins in the order they take groups, and how many groups each takes.
Packing = list[tuple[int, list[tuple[int, int]]]]


def pack_histogram(sizes: Sequence[tuple[int, int]], capacity: int, bins: int | None = None) -> Packing | None:
    """Best-fit decreasing of groups given as (size, how many), sizes distinct. bins: None, open as many as needed;
    else None is returned if they don't do.

    Ties go to the lowest bin. A group above the capacity has a bin of its own, of which the rest is closed.
    """
    tree, used, out = Treap(), 0, []
    for size, many in sorted(sizes, reverse=True):
        runs: list[tuple[int, int]] = []
        while many:
            spot = tree.take((size, -1))
            if spot is None:
                if bins is not None and (used == bins or size > capacity):
                    return None
                spot = (max(capacity, size), used)
                used += 1
            n = min(many, spot[0] // size) if size else many
            many -= n
            runs.append((spot[1], n))
            tree.insert((spot[0] - n * size, spot[1]))
        out.append((size, runs))
    return out


def best_fit_decreasing(sizes: Sequence[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """The bin of each item; of equal items the first comes first."""
    by_size: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        by_size.setdefault(size, []).append(i)
    packed = pack_histogram([(size, len(at)) for size, at in by_size.items()], capacity, bins)
    if packed is None:
        return None
    where = [0] * len(sizes)
    for size, runs in packed:
        items = iter(by_size[size])
        for spot, n in runs:
            for _ in range(n):
                where[next(items)] = spot
    return where


def least_capacity(sizes: Sequence[tuple[int, int]], bins: int) -> Packing:
    """The packing for the least capacity found by bisection with which best-fit decreasing needs no more than so many bins."""
    low = max(max((s for s, _ in sizes), default=0), -(-sum(s * n for s, n in sizes) // bins))
    high, step = low, 1
    best = pack_histogram(sizes, high, bins)
    while best is None:  # mostly little more than the mean will do
        low, high, step = high + 1, high + step, 2 * step
        best = pack_histogram(sizes, high, bins)
    while low < high:
        middle = (low + high) // 2
        tried = pack_histogram(sizes, middle, bins)
        if tried is None:
            low = middle + 1
        else:
            best, high = tried, middle
    return best


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, group of every row, and salt, which spreads repeated rows; null counts as empty."""
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("_t")).select(
        "doc_id", (F.octet_length("_t") + overhead).cast("long").alias("size"), F.crc32("_t").cast("long").alias("text_crc32"), F.unhex(F.sha2("_t", 256)).alias("group"), F.monotonically_increasing_id().alias("salt")
    )


def ranked(rows: DataFrame, key: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows with name: 0, 1, ... among the rows with the same key, in order of `order` and salt, without gaps. And
    the keys: key, _n (rows).

    Rows are sorted by ranges of key, order and salt, so a key with many rows, even if they are alike, is in many
    tasks; each has a row in the table of (key, range) that tells it where its numbers begin.
    """
    by = (key, *order, "salt")
    stored = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()), "ranges")
    stored = stored.withColumn("_range", F.shiftright("_place", 33))
    ranges = materialize(stored.groupBy(key, "_range").agg(F.min("_place").alias("_least"), F.count("*").alias("_n")), "range-sizes")
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.select(key, "_range", (F.col("_least") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_zero"))
    few, first = bounded_broadcast(first, BROADCAST_KEYS)
    out = stored.join(first, [key, "_range"]).withColumn(name, F.col("_place") - F.col("_zero")).drop("_place", "_range", "_zero")
    return out, ranges.groupBy(key).agg(F.sum("_n").alias("_n"))


def assign_shards(rows: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """rows: measure(). Adds shard. Give shards (the least capacity is then found) or a fixed capacity
    (the fewest shards are then opened that best-fit decreasing finds)."""
    spark = rows.sparkSession
    # The partial sums reach the shuffle, not the rows: a text that a third of all rows share is no hot key.
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"), F.lit(0).alias("salt"))
    groups, sizes = ranked(groups, "bytes", ["group"], "place")
    sizes = [(b, n) for b, n in sizes.collect()]
    packed = least_capacity(sizes, shards) if shards else pack_histogram(sizes, capacity)
    table = []
    for size, runs in packed:
        ends, total = [], 0
        for _, n in runs:
            total += n
            ends.append(total)
        table.append((size, ends, [b for b, _ in runs]))
    bins = spark.createDataFrame(
        table, T.StructType([T.StructField("bytes", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("bins", T.ArrayType(T.IntegerType()))])
    )
    runs = sum(len(ends) for _, ends, _ in table)
    groups = groups.join(F.broadcast(bins) if runs <= BROADCAST_KEYS else bins, "bytes")
    # As many bins end at or before the place as come before the group's bin.
    shard = F.get("bins", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
    return skew_join(rows, groups.select("group", "n_rows", shard.alias("shard")), ["group"], "n_rows").drop("n_rows")


def number_slots(placed: DataFrame) -> DataFrame:
    """Adds slot: gapless from 0 in each shard."""
    return ranked(placed, "shard", ["doc_id", "text_crc32"], "slot")[0]


def pack_shards(docs: DataFrame, shards: int | None = 40, capacity: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes plus 16; a null or empty text has 16. Rows of equal text share a
    shard. A text too long for a capacity, or with its copies, has a shard of its own. Rows repeated in full, and
    null identifiers, are rows like others; of rows that are alike any may have any of their slots. Groups
    of equal size are told apart by digest. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    rows = materialize(measure(docs, text, doc_id), "measured")
    out = number_slots(assign_shards(rows, None if capacity else shards, capacity))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40)
