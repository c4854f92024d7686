"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a block lie in one array of symbols. An index maps each mergeable pair,
by its rank, to all positions where it stands; active ranks are taken in ascending order from a heap,
all positions of the rank are merged at once, and the pairs that this makes are filed under their
ranks. A merge only makes pairs of higher rank (checked when a vocabulary is loaded), so one ascending
pass over the whole block gives each pre-token what encoding it alone would give.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import blocks, release, text_bytes

#: As the byte-level pre-tokenizer splits; \s by the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of text whose pre-tokens are encoded together.
BLOCK = 2 << 20
#: Encoded pre-tokens that a task remembers; beyond, it forgets those that its present block doesn't have.
MEMORY = 100_000

_NONE = np.int64(1) << 40


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            chars[chr(extra)] = b
            extra += 1
    return chars


class Vocabulary:
    """A byte-level BPE read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], _byte_chars()
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        ids: dict[str, int] = model["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in ids.items()}
        self.byte_id = np.array([ids[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with stripping aren't supported")
        self.size = max(self.bytes_of) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        rank = np.full(self.size, -1, np.int64)
        rank[self.made] = np.arange(len(pairs))
        if (rank[self.left] >= np.arange(len(pairs))).any() or (rank[self.right] >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before one that makes its part")
        key = self.left * self.size + self.right
        self.order = np.argsort(key)
        self.keys = key[self.order]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(PATTERN).findall

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NONE if it doesn't merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def pieces(self, text: str) -> Iterator[str | int]:
        """Pre-tokens of a text, and the ids of special tokens that stand in it."""
        if self.split is None or not self.special.keys() or not any(s in text for s in self.special):
            yield from self.words(text)
            return
        at = 0
        for m in self.split.finditer(text):
            yield from self.words(text[at : m.start()])
            yield self.special[m.group()]
            at = m.end()
        yield from self.words(text[at:])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of word i are ids[offsets[i]:offsets[i + 1]]."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lengths.sum())
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        edge = np.flatnonzero(np.diff(owner))
        after[edge], after[-1], before[edge + 1] = -1, -1, -1
        alive = np.ones(n, bool)

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(at: np.ndarray) -> None:
            """Puts the pairs that begin at these positions under their ranks."""
            rank = self.ranks(symbol[at], symbol[after[at]])
            keep = rank < _NONE
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            first = 0
            for last in [*cut.tolist(), len(at)]:
                r = int(rank[first])
                if r in index:
                    index[r].append(at[first:last])
                else:
                    index[r] = [at[first:last]]
                    heapq.heappush(heap, r)
                first = last

        file(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (symbol[at] == a)]
            at = at[after[at] >= 0]
            at = at[symbol[after[at]] == b]
            if not len(at):
                continue
            if len(lists) > 1:
                at = np.unique(at)
            if a == b and len(at) > 1:  # in a run of the symbol, every second pair from the left
                joined = np.zeros(len(at), bool)
                joined[1:] = after[at[:-1]] == at[1:]
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbol[at] = self.made[r]
            alive[gone] = False
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            ahead = before[at]
            ahead = ahead[ahead >= 0]
            fresh = np.concatenate([at[has], ahead])
            if len(fresh):
                file(np.unique(fresh))
        total = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(owner[alive], minlength=len(words)), out=total[1:])
        return symbol[alive], total

    def encode(self, text: str) -> list[int]:
        parts = list(self.pieces(text))
        ids, at = self.encode_words([p.encode() for p in parts if isinstance(p, str)])
        out: list[int] = []
        k = 0
        for p in parts:
            if isinstance(p, str):
                out += ids[at[k] : at[k + 1]].tolist()
                k += 1
            else:
                out.append(p)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes that aren't UTF-8 become the replacement character."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    """The place of the public 50k byte-level vocabulary; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """Encodes blocks of texts and remembers pre-tokens: their ids in decimal, number, and decoded bytes."""

    def __init__(self, vocab: Vocabulary, memory: int = MEMORY, with_ids: bool = True) -> None:
        self.vocab, self.memory, self.with_ids = vocab, memory, with_ids
        self.text_of: dict[str | int, str] = {}
        self.bytes_of: dict[str | int, bytes] = {}
        self.ids_of: dict[str | int, bytes] = {}
        self._forget(set())

    def _forget(self, found: set) -> None:
        """Keeps what is found just now, so that common pre-tokens stay known."""
        for known in (self.text_of, self.bytes_of, self.ids_of):
            keep = {w: known[w] for w in found if w in known}
            known.clear()
            known.update(keep)
        for i in self.vocab.special.values():
            self.text_of[i], self.bytes_of[i], self.ids_of[i] = str(i), self.vocab.bytes_of[i], np.int32(i).tobytes()

    def _learn(self, found: set) -> None:
        new = [w for w in found if w not in self.text_of]
        if not new:
            return
        if len(self.text_of) + len(new) > self.memory:
            self._forget(found)
        ids, at = self.vocab.encode_words([w.encode() for w in new])
        text = list(map(str, ids.tolist()))
        packed = ids.astype(np.int32).tobytes()
        raw = list(map(self.vocab.bytes_of.__getitem__, ids.tolist()))
        first = 0
        for w, last in zip(new, at[1:].tolist()):
            self.text_of[w] = ",".join(text[first:last])
            self.bytes_of[w] = b"".join(raw[first:last])
            if self.with_ids:
                self.ids_of[w] = packed[4 * first : 4 * last]
            first = last

    def encode(self, texts: list[str]) -> list[tuple[str, bytes, bytes]]:
        """For each text its ids, in decimal and joined by commas, their bytes, and the ids as 32-bit numbers."""
        words, special = self.vocab.words, self.vocab.special
        parts = [list(self.vocab.pieces(t)) if any(s in t for s in special) else words(t) for t in texts]
        found: set = set()
        for p in parts:
            found.update(p)
        self._learn(found)
        text, raw, ids = self.text_of.__getitem__, self.bytes_of.__getitem__, self.ids_of.__getitem__
        return [(",".join(map(text, p)), b"".join(map(raw, p)), b"".join(map(ids, p)) if self.with_ids else b"") for p in parts]


def _encoded(path: str, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what earlier stages left
        codec = Codec(vocabulary(path), with_ids=with_ids)
        for b in batches:
            _, offsets = text_bytes(b.column(1))
            for i, j in blocks(offsets, BLOCK):
                n, ids_hash, text_hash, ids = [], [], [], []
                for decimal, raw, packed in codec.encode([t or "" for t in b.column(1).slice(i, j - i).to_pylist()]):
                    n.append(decimal.count(",") + 1 if decimal else 0)
                    ids_hash.append(hashlib.sha256(decimal.encode()).hexdigest())
                    text_hash.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                    if with_ids:
                        ids.append(packed)
                columns = [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    at = np.zeros(len(ids) + 1, np.int32)
                    np.cumsum([len(x) // 4 for x in ids], out=at[1:])
                    columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        del codec
        release()

    return encode


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_docs(docs: DataFrame, path: str | None = None, with_ids: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids.

    A null or empty text has no tokens; a very long one is encoded whole, in a block of its own. Strings of special tokens in a text are their ids.
    Repeated rows are encoded each; an empty table gives no rows; other columns are ignored, whatever
    their names. No shuffle: each text is encoded where it is read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(path or default_path(), with_ids), _SCHEMA + (", ids array<int>" if with_ids else ""))


def decode_docs(encoded: DataFrame, path: str | None = None, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text of rows with ids; null ids give null. Bytes that aren't UTF-8 become U+FFFD."""
    where = path or default_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(where)
        for b in batches:
            texts = [None if x is None else vocab.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(decode, "doc_id long, text string")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_docs(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
