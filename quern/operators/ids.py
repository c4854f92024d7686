"""Dense identifiers in the order of a key, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.workspace import write_table


def dense_ids(rows: DataFrame, *order: str, name: str = "dense_id") -> DataFrame:
    """rows with name: 1, 2, ... in the order of the columns (bytes order for strings).

    Rows are range-partitioned and sorted, written once, and each range gets its offset from the sizes of
    those before it; the driver sees one number for each range.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    return numbered_places(write_table(sorted_, "ids"), name)


def numbered_places(stored: DataFrame, name: str = "dense_id") -> DataFrame:
    """Rows of a written table with name in place of _place, the monotonically_increasing_id of sorted ranges."""
    stored = stored.withColumn("_part", F.shiftright("_place", 33))
    sizes = sorted((r["_part"], r["n"]) for r in stored.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    table = stored.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    return stored.join(F.broadcast(table), "_part").withColumn(name, F.col("_offset") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_place", "_part", "_offset")
