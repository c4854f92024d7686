"""Mixing sources to target weights by the cube method.

A source's documents all enter with the same expected number of copies, target / source size. The
whole part of it is taken outright; its fraction is an inclusion probability. The flight phase moves
these probabilities along the null space of the balancing constraints (the document count and the
token count), three documents at a time, until each but two of a group is 0 or 1, so both totals of
the group stay what they were. Groups are (source, chunk) with about CHUNK rows; the few undecided of
FAN chunks meet in the next round, until each source has one group. There a landing problem of two
documents remains, solved by trying its four outcomes.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from quern.llm.common import WORD, materialize, skew_join
from quern.operators.ids import dense_ids

CHUNK = 50_000
#: Rows that are alike which one task writes out.
ALIKE = 100_000
FAN = 1024
#: Sources whose targets the driver computes and that may be broadcast; with more both is done by tables.
LOCAL_SOURCES = 100_000
WEIGHTS = (3.0, 1.0, 2.0)

_EPS = 1e-9


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets in proportion to the weights with sum share * sum(sizes), none above most * its size;
    what is over is shared again by weight."""
    left, open_, target = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= full
    return target


def null_vector(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float]) -> tuple[float, float, float]:
    """u != 0 with u0 * a + u1 * b + u2 * c = 0, largest entry 1."""
    u = (b[0] * c[1] - b[1] * c[0], c[0] * a[1] - c[1] * a[0], a[0] * b[1] - a[1] * b[0])
    most = max(abs(x) for x in u)
    if most < 1e-12:  # all on one line: two of them will do
        for i, j in ((0, 1), (0, 2), (1, 2)):
            p, q = (a, b, c)[i], (a, b, c)[j]
            u = [0.0, 0.0, 0.0]
            u[i], u[j] = (q[0], -p[0]) if abs(p[0]) + abs(q[0]) > 1e-12 else (q[1], -p[1])
            most = max(abs(x) for x in u)
            if most > 1e-12:
                break
    return u[0] / most, u[1] / most, u[2] / most


def flight(prob: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Moves probabilities to 0 or 1, all but two at most, with the sums of prob and of prob * size kept.

    The balancing variables are 1 and the size over the mean size, divided by the first probability
    as the method asks; equal probabilities in a group make that division the same for all.
    """
    prob = list(prob)
    mean = sum(size) / len(size) if size else 1.0
    held: list[int] = []
    row = [(1.0, s / (mean or 1.0)) for s in size]
    for i in range(len(prob)):
        if _EPS < prob[i] < 1 - _EPS:
            held.append(i)
        while len(held) == 3:
            u = null_vector(row[held[0]], row[held[1]], row[held[2]])
            up = down = math.inf
            for k, x in zip(held, u):
                if x > 0:
                    up, down = min(up, (1 - prob[k]) / x), min(down, prob[k] / x)
                elif x < 0:
                    up, down = min(up, prob[k] / -x), min(down, (1 - prob[k]) / -x)
            step = up if rng.random() * (up + down) < down else -down
            for k, x in zip(held, u):
                p = prob[k] + step * x
                prob[k] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p
            held = [k for k in held if 0.0 < prob[k] < 1.0]
    return prob


def landing(prob: list[float], size: list[float]) -> list[float]:
    """Of the outcomes for the two undecided, the one nearest to the sums, tokens first."""
    free = [i for i, p in enumerate(prob) if 0.0 < p < 1.0]
    want, best, where = sum(prob[i] * size[i] for i in free), math.inf, 0
    for k in range(1 << len(free)):
        off = abs(want - sum(size[i] for j, i in enumerate(free) if k >> j & 1))
        if off < best - _EPS:
            best, where = off, k
    out = list(prob)
    for j, i in enumerate(free):
        out[i] = float(where >> j & 1)
    return out


def sizes_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", ref: str | None = None) -> DataFrame:
    """doc_id, ref, source, size (words) of every row; a null text has none."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.col(ref) if ref else F.lit(0)).alias("ref"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, local: int = LOCAL_SOURCES) -> tuple[DataFrame, bool]:
    """source, source_size, source_rows, target; and whether there are at most `local` sources. Sources by code
    point, null last."""
    found = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")), "sources")
    if found.count() > local:
        return many_targets(found, weights, share, most), False
    some = sorted(found.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    target = water_fill([r["source_size"] for r in some], [weights[i % len(weights)] for i in range(len(some))], share, most)
    schema = "source string, source_size long, source_rows long, target double"
    return rows.sparkSession.createDataFrame([(*r, t) for r, t in zip(some, target)], schema), True


def many_targets(found: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """water_fill() by aggregates: each turn finds the unit of the sources that aren't full, until no more are."""
    order = (F.col("source").isNull(), "source")
    place = dense_ids(found.withColumn("_none", order[0]), "_none", "source", name="_number")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_number") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = materialize(place.select("source", "source_size", "source_rows", weight.alias("_weight")), "weights")
    full = F.col("_weight") * F.lit(0.0) > 0  # none
    unit, n_full = 0.0, -1
    while True:
        size = F.col("source_size")
        r = table.agg(F.sum(size).alias("all"), F.sum(F.when(full, size)).alias("full"), F.sum(F.when(~full, F.col("_weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if r["n"] == n_full or not r["open"]:
            break
        n_full, unit = r["n"], (share * r["all"] - most * (r["full"] or 0)) / r["open"]
        full = full | (F.lit(unit) * F.col("_weight") > most * size)
    return table.select("source", "source_size", "source_rows", F.when(full, most * F.col("source_size")).otherwise(F.lit(unit) * F.col("_weight")).alias("target"))


def _fly(seed: int, turn: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Flight, and in the last round landing, for one (source, chunk)."""

    def fly(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "ref"], kind="stable").reset_index(drop=True)
        rng = random.Random(f"{seed}/{turn}/{keys}")
        prob, size = pdf["prob"].tolist(), pdf["size"].tolist()
        free = [i for i, p in enumerate(prob) if 0.0 < p < 1.0]
        rng.shuffle(free)
        sizes = [float(size[i]) for i in free]
        moved = flight([prob[i] for i in free], sizes, rng)
        if last:
            moved = landing(moved, sizes)
        for i, p in zip(free, moved):
            prob[i] = p
        return pdf.assign(prob=prob)

    return fly


def balanced_copies(rows: DataFrame, mix: DataFrame, few: bool = True, seed: int = 17, chunk: int = CHUNK) -> DataFrame:
    """rows: sizes_of(); mix, few: targets(). Adds source_size, target and copies."""
    most = mix.agg(F.max("source_rows")).first()[0] or 1
    # Rows that are alike are one row with their number, whatever it is.
    rows = rows.groupBy("doc_id", "ref", "source", "size").agg(F.count("*").alias("alike"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chunks = F.greatest(F.ceil(F.col("source_rows") / chunk), F.lit(1))
    # Without nulls, so that sources too many to broadcast can be joined as hot and other keys.
    named = mix.select(F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("_named"), "source_size", "source_rows", "target")
    level = rows.withColumn("_named", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    level = level.join(F.broadcast(named), "_named") if few else skew_join(level, named, ["_named"], "source_rows")
    level = level.select(
        "doc_id", "ref", "source", "size", "source_size", "target", "alike", F.floor(expected).cast("double").alias("whole"), (F.col("alike") * (expected - F.floor(expected))).alias("prob"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "ref"), chunks).cast("long").alias("chunk"),
    )
    # So many of them have one copy more than the whole part for certain; the rest of it is a probability.
    level = level.withColumn("sure", F.floor("prob")).withColumn("prob", F.col("prob") - F.floor("prob"))
    schema = level.schema
    groups = max(1, -(-most // chunk))
    done: list[DataFrame] = []
    turn = 0
    while True:
        last = groups == 1

        level = materialize(level.groupBy("source", "chunk").applyInPandas(_fly(seed, turn, last), schema), "flight")
        if last:
            done.append(level)
            break
        open_ = (F.col("prob") > 0) & (F.col("prob") < 1)
        done.append(level.filter(~open_))
        level = level.filter(open_).withColumn("chunk", F.floor(F.col("chunk") / FAN))
        groups = -(-groups // FAN)
        turn += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = out.withColumn("_first", F.explode(F.sequence(F.lit(1), F.col("alike"), F.lit(ALIKE))))
    if out.filter(F.col("_first") > 1).limit(1).count():
        out = out.repartition(F.xxhash64("doc_id", "_first"))
    out = out.withColumn("_i", F.explode(F.sequence(F.col("_first"), F.least("alike", F.col("_first") + ALIKE - 1))))
    more = (F.col("_i") <= F.col("sure") + F.col("prob")).cast("int")
    return out.select("doc_id", "ref", "source", "size", "source_size", "target", (F.col("whole") + more).cast("int").alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, chunk: int = CHUNK, text: str = "text", doc_id: str = "doc_id", source: str = "source", ref: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken, and ref if a
    column is named that the caller knows rows by.

    A null or empty text has size 0 and may be chosen, for 0 words; a very long one is one document like others, so
    its source's words may miss their target by as much. Rows without a source are a source of their own, the
    last. Of repeated rows, alike in identifier, source and size, their share is taken, one more or less;
    those beyond have a copy less. With the same rows a rerun chooses the same; most is at least 1 and bounds a
    document's copies. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = materialize(sizes_of(docs, text, doc_id, source, ref), "sizes")
    out = balanced_copies(rows, *targets(rows, weights, share, most), seed, chunk)
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out if ref else out.drop("ref")


def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


