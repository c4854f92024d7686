"""Quality rules as a bitmask ledger.

Each text is measured once and each rule evaluated once; the ledger keeps the measurements and one
bit for each rule that failed. Policies are versioned masks over these bits, applied without reading
a text again, and ablations (what a policy drops, what each of its rules alone drops) come from
counts of the distinct masks, of which there are no more than rules allow, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SPACE, blocks, mix, per_row, span_hashes, spans, text_bytes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bars", "n_bangs", "n_upper", "n_ascii_letters", "n_long_words")
#: Words of over so many bytes count as long.
LONG_WORD = 100
#: Words in a window that is looked for twice in a text.
WINDOW = 5


def _c(name: str) -> Column:
    return F.col(name)


#: name, condition under which a text fails; a rule's bit is its place here. Append only.
RULES: tuple[tuple[str, Callable[[], Column]], ...] = (
    ("few_words", lambda: _c("n_words") < 10),
    ("repeated_words", lambda: 100 * _c("n_repeat_words") > 20 * _c("n_words")),
    ("symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    ("duplicate_lines", lambda: 2 * _c("n_dup_lines") > _c("n_lines")),
    ("table_cells", lambda: 10 * _c("n_bars") > _c("n_words")),
    ("shouting", lambda: 10 * _c("n_bangs") > _c("n_words")),
    ("capitals", lambda: 10 * _c("n_upper") > 4 * _c("n_ascii_letters")),
    ("short_words", lambda: 2 * _c("word_chars") < 5 * _c("n_words")),
    ("long_words", lambda: 20 * _c("n_long_words") > _c("n_words")),
    ("wide_words", lambda: _c("word_chars") > 20 * _c("n_words")),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versions stay as they are once used; a new one is added.
POLICIES: dict[str, int] = {
    "base-1": BIT["few_words"] | BIT["repeated_words"],
    "web-1": sum(BIT[x] for x in ("few_words", "repeated_words", "symbols", "duplicate_lines", "table_cells", "shouting", "capitals", "short_words", "long_words", "wide_words")),
}


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _UPPER = _table(b"#*$%&|<>"), _table(bytes(range(65, 91)))
_LETTER = _UPPER | _table(bytes(range(97, 123)))
_BREAK = _table(b"\n")


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(keys)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(again):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
    return again[at] == keys


def measure_block(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """MEASURES of each text data[offsets[i]:offsets[i + 1]], in UTF-8."""
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(n, np.int64) for _ in MEASURES]
    start, end = spans(data, offsets)
    words = np.searchsorted(start, offsets)  # words[i]: the first word of text i
    owner = np.repeat(np.arange(n), np.diff(words))
    lead = (data & 0xC0) != 0x80
    chars = per_row(lead & ~SPACE[data], offsets)

    line_start, line_end = spans(data, offsets, _BREAK)
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_owner = np.searchsorted(offsets, line_start, "right") - 1
    tag = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    line_key = mix(span_hashes(data, line_start, line_end) ^ tag[line_owner] ^ mix((line_end - line_start).astype(np.uint64)))
    lines = np.bincount(line_owner, minlength=n)
    _, where = np.unique(line_key, return_index=True)
    dup_lines = lines - np.bincount(line_owner[where], minlength=n)

    repeat = np.zeros(n, np.int64)
    if len(start) >= WINDOW:
        h = span_hashes(data, start, end)
        m = len(h) - WINDOW + 1
        g = h[:m].copy()
        for k in range(1, WINDOW):
            g = mix(g) + h[k : k + m]
        whole = owner[:m] == owner[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        hit = at[_twice(mix(g[at] ^ tag[owner[at]]))]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        repeat = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=n)
    return [
        np.diff(words), chars, per_row(_SYMBOL[data], offsets), dup_lines, repeat, lines, per_row(data == ord("|"), offsets), per_row(data == ord("!"), offsets),
        per_row(_UPPER[data], offsets), per_row(_LETTER[data], offsets), np.bincount(owner[end - start > LONG_WORD], minlength=n),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        found: list[list[np.ndarray]] = [[] for _ in MEASURES]
        for i, j in blocks(offsets):
            for out, x in zip(found, measure_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                out.append(x)
        columns = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in found]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, MEASURES, fail_bits.

    A null or empty text has measures of 0 and fails few_words; a very long one is measured whole. Repeated rows are
    measured each; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.mapInArrow(_measured, ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES)]))
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(fails(), F.lit(BIT[name])).otherwise(0).cast("long"))
    return rows.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """Adds policy and kept to a ledger."""
    return rows.withColumns({"policy": F.lit(version), "kept": F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0})


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: rows, dropped (by the whole policy), fails (the rule), alone (rows
    that only this rule drops), dropped_without (by the policy without the rule)."""
    mask = F.lit(POLICIES[version]).cast("long")
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(BIT[k]).cast("long").alias("bit")) for k, _ in RULES if BIT[k] & POLICIES[version])))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return (
        counts.withColumn("r", rule)
        .groupBy("r.rule")
        .agg(
            F.sum("n").alias("rows"), count(F.col("bits") != 0).alias("dropped"), count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("fails"),
            count(F.col("bits") == F.col("r.bit")).alias("alone"), count(F.col("bits").bitwiseAND(F.bitwise_not("r.bit")) != 0).alias("dropped_without"),
        )
    )


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "web-1")
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base-1"]).cast("long")) != 0
    return rows.select("doc_id", *MEASURES[:5], base.alias("base_failed"), F.col("kept"), "fail_bits")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i : i + 4]) AS n FROM p),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM g, range(5) AS r(k) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM c GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^|]', '', 'g')) AS n_bars, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
         len(list_filter(w, lambda x: strlen(x) > 100)) AS n_long
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END | CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    | CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END | CASE WHEN 10 * n_bars > n_words THEN 16 ELSE 0 END | CASE WHEN 10 * n_bangs > n_words THEN 32 ELSE 0 END
    | CASE WHEN 10 * n_upper > 4 * n_letters THEN 64 ELSE 0 END | CASE WHEN 2 * word_chars < 5 * n_words THEN 128 ELSE 0 END | CASE WHEN 20 * n_long > n_words THEN 256 ELSE 0 END
    | CASE WHEN word_chars > 20 * n_words THEN 512 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
