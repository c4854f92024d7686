"""The tokenizer, as column expressions: documents and queries go through the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = tuple(
    "a all an and are as at be both but by can each every few for from had has have he how in is it its just more most no nor not now of on only other own same should so some such than that the they this to too very was what when where which who why will with".split()
)
WHITE_SPACE = r"[\p{IsWhite_Space}]+"
EDGES = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"
#: What cleaning leaves as it is.
PLAIN = r"^[a-z0-9]+\z"
VALID = "^[a-z0-9-]{1,20}$"
MAX_TERM = 20


def split_words(text: Column) -> Column:
    """Raw words: what stands between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), lambda x: x != "")


def clean_word(word: Column) -> Column:
    """Without other than letters and digits at both ends, in lower case. Most words are so already."""
    return F.when(word.rlike(PLAIN), word).otherwise(F.lower(F.regexp_replace(word, EDGES, "")))


def is_valid_token(term: Column) -> Column:
    return term.rlike(VALID)


def is_stop_word(term: Column) -> Column:
    return term.isin(*STOP_WORDS)


def is_token(term: Column) -> Column:
    return is_valid_token(term) & ~is_stop_word(term)


def token_array(text: Column) -> Column:
    """Surviving tokens in order, without positions."""
    return F.filter(F.transform(split_words(text), clean_word), is_token)


def doc_length(text: Column) -> Column:
    return F.size(token_array(text))


def once(value: Column) -> Column:
    """The value, of an expression that isn't a function of the row: the planner copies it into no filter or lambda above,
    where it would be computed again for each row or element."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def tokenize(rows: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """keys, pos, term of each surviving token. pos counts all raw words, also those that are dropped."""
    # Words are cleaned before they are rows: in a projection after it, filters would clean each word again.
    terms = F.transform(split_words(F.col(text)), clean_word)
    return rows.select(*keys, once(terms).alias("_words")).select(*keys, F.posexplode("_words").alias("pos", "term")).filter(is_token(F.col("term")))


def placed_tokens(text: Column) -> Column:
    """Surviving tokens as structs of term and pos; pos counts all raw words."""
    words = F.transform(F.transform(split_words(text), clean_word), lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    return F.filter(words, lambda x: is_token(x["term"]))


def count_terms(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """rows with doc_len and terms in place of tokens (as placed_tokens gives them): each term of the row once, with its
    positions, ascending. A row is counted by itself, so nothing is shuffled."""
    keys = [c for c in rows.columns if c != tokens]
    rows = rows.select(*keys, once(F.sort_array(tokens)).alias("_sorted"))
    new = lambda x, i: F.when((i == 0) | (x["term"] != F.get(F.col("_sorted"), i - 1)["term"]), i)
    rows = rows.select(*keys, "_sorted", once(F.filter(F.transform("_sorted", new), lambda i: i.isNotNull())).alias("_first"))
    size = F.size("_sorted")
    positions = lambda i, k: F.transform(F.slice("_sorted", i + 1, F.coalesce(F.get(F.col("_first"), k + 1), size) - i), lambda x: x["pos"])
    terms = F.transform("_first", lambda i, k: F.struct(F.get(F.col("_sorted"), i)["term"].alias("term"), positions(i, k).alias("positions")))
    return rows.select(*keys, size.alias("doc_len"), once(terms).alias("terms"))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def flatten_paragraphs(paragraphs: Column) -> Column:
    """Sentences joined, a blank line between paragraphs, tags removed."""
    return strip_tags(F.array_join(F.transform(paragraphs, lambda p: F.array_join(p, "")), "\n\n"))


#: Latin letters with marks, and what stands for them.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"


def transliterate(text: Column) -> Column:
    """Without marks on Latin letters. The tokenizer doesn't do this by itself: apply it to the text before."""
    return F.translate(text, _MARKED, _PLAIN)
