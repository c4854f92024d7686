"""Terms within an edit distance of a word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similar_terms(terms: DataFrame, word: str, distance: int = 1) -> DataFrame:
    """term, distance. Lengths are compared first; the edit distance stops once it is over the limit."""
    near = terms.filter(F.abs(F.length("term") - len(word)) <= distance)
    found = near.select("term", F.levenshtein("term", F.lit(word), distance).alias("distance"))
    return found.filter("distance >= 0")
