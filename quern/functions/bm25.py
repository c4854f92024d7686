"""BM25 as column arithmetic. idf isn't clamped, so a term in over half of all documents weighs below 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75

    def tf(self, count: Column, doc_len: Column, avgdl: Column) -> Column:
        return count * (self.k1 + 1) / (count + self.k1 * ((1 - self.b) + self.b * doc_len / avgdl))

    def score(self, n_docs: Column, df: Column, count: Column, doc_len: Column, avgdl: Column) -> Column:
        return idf(n_docs, df) * self.tf(count, doc_len, avgdl)


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln((n_docs - df + 0.5) / (df + 0.5))


def rounded(score: Column) -> Column:
    """To 6 places, and never -0."""
    return F.round(score, 6) + F.lit(0.0)
