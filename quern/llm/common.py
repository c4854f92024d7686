"""What the operators share: tables in the shared folder, text in numpy, bytes of a column."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other than these bytes; in UTF-8 they never occur inside a character.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"

_R = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_RI = pow(_R, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Where it names none, a temporary one of this
    machine if all executors are on it; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, written once as a table in the shared folder and read from there: cuts the lineage and
    survives the loss of executors. checkpoint() would compute df twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """materialize() in buckets of key, as many as a shuffle has partitions: a join on key then doesn't
    shuffle the table."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("compression", "zstd")
    writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Deletes the table that materialize() wrote for df; nothing may read it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_broadcast(df: DataFrame, max_rows: int) -> tuple[bool, DataFrame]:
    """(True, hinted df) if df has at most max_rows rows, else (False, df)."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return few, F.broadcast(df) if few else df


def release() -> None:
    """Gives freed memory back to the system: a worker process goes on to other stages with what it has."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _R), ("down", _RI)):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def spans(data: np.ndarray, cuts: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't in space; none crosses a cut."""
    n = len(data)
    inside = ~space[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each row [offsets[i], offsets[i + 1]) has."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 1 << 21) -> np.ndarray:
    """A 64-bit hash of each data[start:end], whatever its place; spans must be sorted and disjoint.

    Works on pieces of the data, so that a very long text needs little memory.
    """
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, lo + piece, "right")))
        up, down = powers(int(end[j - 1]) - lo + 1)
        total = np.zeros(int(end[j - 1]) - lo + 1, np.uint64)
        np.cumsum((data[lo : int(end[j - 1])].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about size bytes each; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


#: A key with over this part of all rows is joined by broadcast; there are fewer such keys than HOT.
HOT = 1000


def skew_join(rows: DataFrame, table: DataFrame, key: list[str], count: str, total: int | None = None) -> DataFrame:
    """rows joined with table on key, which is unique in table; `count` there says how many rows have it, in
    total at most `total` (else they are counted).

    A key with over 1 / HOT of all rows is broadcast, so there are at most HOT of them; no task of the
    other join gets a key with more rows than that.
    """
    if total is None:
        table = materialize(table, "lookup")
        total = table.agg(F.sum(count)).first()[0] or 0
    limit = max(total // HOT, 1)
    names = [c for c in table.columns if c not in key]
    hot = table.filter(F.col(count) > limit).select(*key, F.struct(*names).alias("_hot"))
    cold = table.filter(F.col(count) <= limit).select(*key, F.struct(*names).alias("_cold"))
    marked = rows.join(F.broadcast(hot), key, "left")
    done = marked.filter(F.col("_hot").isNotNull()).select(*rows.columns, "_hot.*")
    rest = marked.filter(F.col("_hot").isNull()).select(*rows.columns).join(cold, key).select(*rows.columns, "_cold.*")
    return done.unionByName(rest)
