"""Integer codecs for posting lists, as Arrow-batched functions on arrays: VarByte, Simple9, Simple16,
PForDelta and Rice, each with or without gaps. An encoded list says its own length, so lists that
start with 0 or are empty come back whole. Values are from 0 to 2**32 - 1."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (how many, bits of each) for each selector.
SIMPLE9 = tuple(((28 // b,) * 1, b) for b in (1, 2, 3, 4, 5, 7, 9, 14, 28))
_S9 = tuple((b,) * n for (n,), b in SIMPLE9)
_S16 = (
    (1,) * 28, (2,) * 7 + (1,) * 14, (1,) * 7 + (2,) * 7 + (1,) * 7, (1,) * 14 + (2,) * 7, (2,) * 14, (4,) + (3,) * 8, (3,) + (4,) * 4 + (3,) * 3, (4,) * 7,
    (5,) * 4 + (4,) * 2, (4,) * 2 + (5,) * 4, (6,) * 3 + (5,) * 2, (5,) * 2 + (6,) * 3, (7,) * 4, (10, 9, 9), (14,) * 2, (28,),
)
#: A selector that neither table uses stands before a value of over 28 bits.
BLOCK = 128


def _check(values: np.ndarray) -> list[int]:
    if len(values) and (values.min() < 0 or values.max() >= 1 << 32):
        raise ValueError("values must be from 0 to 2**32 - 1")
    return values.tolist()


def varbyte_encode(values: np.ndarray) -> bytes:
    out = bytearray()
    for v in _check(values):
        while v >= 128:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def varbyte_decode(data: bytes) -> list[int]:
    out, v, shift = [], 0, 0
    for b in data:
        v |= (b & 127) << shift
        if b & 128:
            shift += 7
        else:
            out.append(v)
            v = shift = 0
    return out


def _modes(modes: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(selectors, 28): bits and shift of each place of a word, 0 bits where there is none; values of a word."""
    bits = np.array([m + (0,) * (28 - len(m)) for m in modes], np.int64)
    shift = 4 + np.cumsum(bits, axis=1) - bits
    return bits, shift, np.array([len(m) for m in modes])


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of all lists."""
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return np.concatenate([np.zeros(0, np.int64), *lists]), offsets


def _packed_encode(lists: list[np.ndarray], modes: tuple[tuple[int, ...], ...]) -> list[bytes]:
    """Words of 32 bits: 4 of selector, 28 of values. Values of over 28 bits are exceptions at the front. All lists
    get their next word at once, by the first selector that fits."""
    bits, shift, many = _modes(modes)
    values, offsets = _flat(lists)
    if len(values) and (values.min() < 0 or values.max() >= 1 << 32):
        raise ValueError("values must be from 0 to 2**32 - 1")
    low = values & ((1 << 28) - 1)
    need = np.ceil(np.log2(low + 1)).astype(np.int64)
    large = np.flatnonzero(values >= 1 << 28)
    of = np.searchsorted(offsets, large, "right") - 1
    at, end, live = offsets[:-1].copy(), offsets[1:], np.flatnonzero(np.diff(offsets))
    owner, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    place = np.arange(28)
    while len(live):
        i = at[live][:, None] + place
        inside = i < end[live][:, None]
        i = np.minimum(i, len(values) - 1)
        wanted = np.where(inside, need[i], 0)
        pick = np.full(len(live), -1)
        for selector in range(len(modes)):
            open_ = np.flatnonzero(pick < 0)
            if not len(open_):
                break
            n = many[selector]
            pick[open_[(wanted[open_, :n] <= bits[selector, :n]).all(1)]] = selector
        used = inside & (place < many[pick][:, None])
        word = pick + np.where(used, low[i] << shift[pick], 0).sum(1)
        owner.append(live)
        words.append(word.astype(np.uint32))
        at[live] += used.sum(1)
        live = live[at[live] < end[live]]
    owner, words = np.concatenate(owner), np.concatenate(words)
    order = np.argsort(owner, kind="stable")
    words, cut = words[order], np.searchsorted(owner[order], np.arange(len(lists) + 1))
    first = np.searchsorted(of, np.arange(len(lists) + 1))
    out = []
    for k, x in enumerate(lists):
        own = large[first[k] : first[k + 1]]
        head = np.concatenate([[len(x), len(own)], np.stack([own - offsets[k], values[own]], 1).reshape(-1)])
        out.append(head.astype("<u4").tobytes() + words[cut[k] : cut[k + 1]].astype("<u4").tobytes())
    return out


def _packed_decode(blobs: list[bytes], modes: tuple[tuple[int, ...], ...]) -> list[np.ndarray]:
    bits, shift, many = _modes(modes)
    numbers = [np.frombuffer(b, "<u4").astype(np.int64) for b in blobs]
    sizes = np.array([x[0] for x in numbers], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    words, cut = _flat([x[2 + 2 * int(x[1]) :] for x in numbers])
    owner = np.repeat(np.arange(len(blobs)), np.diff(cut))
    selector = words & 15
    count = many[selector]
    before = np.concatenate([[0], np.cumsum(count)])
    start = before[:-1] - before[cut[:-1]][owner] + offsets[owner]
    out = np.zeros(int(offsets[-1]), np.int64)
    for s in range(len(modes)):
        rows = np.flatnonzero(selector == s)
        for j in range(many[s]):
            to = start[rows] + j
            fits = to < offsets[owner[rows] + 1]
            out[to[fits]] = words[rows[fits]] >> shift[s, j] & ((1 << int(bits[s, j])) - 1)
    for x, first in zip(numbers, offsets):
        for k in range(int(x[1])):
            out[first + x[2 + 2 * k]] = x[3 + 2 * k]
    return np.split(out, offsets[1:-1]) if len(blobs) else []


def _bits(values: list[int], width: int) -> bytes:
    """Values of width bits, the lowest bit first."""
    total = 0
    for i, v in enumerate(values):
        total |= v << (i * width)
    return total.to_bytes(-(-len(values) * width // 8), "little")


def _unbits(data: bytes, n: int, width: int) -> list[int]:
    total = int.from_bytes(data, "little")
    return [total >> (i * width) & ((1 << width) - 1) for i in range(n)]


def pfor_encode(values: np.ndarray) -> bytes:
    """Blocks of 128: the width that nine of ten values need; the others' upper bits are exceptions."""
    all_ = _check(values)
    out = [struct.pack("<I", len(all_))]
    for at in range(0, len(all_), BLOCK):
        part = all_[at : at + BLOCK]
        widths = sorted(v.bit_length() for v in part)
        width = widths[max(0, -(-len(part) * 9 // 10) - 1)]
        extra = [(i, v >> width) for i, v in enumerate(part) if v >> width]
        body = _bits([v & ((1 << width) - 1) for v in part], width)
        out.append(struct.pack("<BBH", width, len(extra), len(body)) + body + b"".join(struct.pack("<BI", i, v) for i, v in extra))
    return b"".join(out)


def pfor_decode(data: bytes) -> list[int]:
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    while len(out) < n:
        width, extra, size = struct.unpack_from("<BBH", data, at)
        at += 4
        part = _unbits(data[at : at + size], min(BLOCK, n - len(out)), width)
        at += size
        for _ in range(extra):
            i, v = struct.unpack_from("<BI", data, at)
            part[i] |= v << width
            at += 5
        out += part
    return out


def rice_encode(values: np.ndarray) -> bytes:
    """Quotients in unary, remainders in as many bits as suit the mean."""
    all_ = _check(values)
    mean = sum(all_) / len(all_) if all_ else 0
    k = max(0, int(mean * 0.69).bit_length() - 1 if mean >= 1 else 0)
    while all_ and max(all_) >> k > 4096:
        k += 1
    bits, at = 0, 0
    for v in all_:
        q = v >> k
        bits |= ((1 << q) - 1) << at
        at += q + 1
        bits |= (v & ((1 << k) - 1)) << at
        at += k
    return struct.pack("<IB", len(all_), k) + bits.to_bytes(-(-at // 8), "little")


def rice_decode(data: bytes) -> list[int]:
    n, k = struct.unpack_from("<IB", data)
    bits = int.from_bytes(data[5:], "little")
    out = []
    for _ in range(n):
        q = (~bits & (bits + 1)).bit_length() - 1
        bits >>= q + 1
        out.append(q << k | bits & ((1 << k) - 1))
        bits >>= k
    return out


#: Of one list, and of what it is encoded to.
CODECS: dict[str, tuple[Callable[[np.ndarray], bytes], Callable[[bytes], list[int]]]] = {
    "varbyte": (varbyte_encode, varbyte_decode),
    "simple9": (lambda v: _packed_encode([v], _S9)[0], lambda d: _packed_decode([d], _S9)[0].tolist()),
    "simple16": (lambda v: _packed_encode([v], _S16)[0], lambda d: _packed_decode([d], _S16)[0].tolist()),
    "pfordelta": (pfor_encode, pfor_decode),
    "rice": (rice_encode, rice_decode),
}
_MODES = {"simple9": _S9, "simple16": _S16}
DEFAULT = "simple16"


def check_codec(name: str) -> str:
    if name not in CODECS:
        raise ValueError(f"no codec {name!r}; there are {', '.join(CODECS)}")
    return name


def gaps(values: Column) -> Column:
    """Each value less the one before it; the first stays."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def ungaps(values: Column) -> Column:
    """Running sums: the inverse of gaps."""
    return sums_before(values, including=True)


def sums_before(values: Column, including: bool = False) -> Column:
    """The sum of the values before each (including: and of itself), in one batched pass."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(lists: pd.Series) -> pd.Series:
        total = lists.map(lambda x: None if x is None else np.cumsum(np.asarray(x, np.int64)))
        return total if including else pd.Series([None if x is None else t - np.asarray(x, np.int64) for x, t in zip(lists, total)], dtype=object)

    return run(values.cast("array<bigint>"))


def encode(values: Column, codec: str = DEFAULT, with_gaps: bool = False) -> Column:
    one, modes = CODECS[check_codec(codec)][0], _MODES.get(codec)
    many = (lambda lists: _packed_encode(lists, modes)) if modes else (lambda lists: list(map(one, lists)))

    @F.pandas_udf(T.BinaryType())
    def run(lists: pd.Series) -> pd.Series:
        known = [np.asarray(x, np.int64) for x in lists if x is not None]
        done = iter(many([np.diff(x, prepend=0) for x in known] if with_gaps else known))
        return pd.Series([None if x is None else next(done) for x in lists], dtype=object)

    return run(values.cast("array<bigint>"))


def decode(data: Column, codec: str = DEFAULT, with_gaps: bool = False) -> Column:
    one, modes = CODECS[check_codec(codec)][1], _MODES.get(codec)
    many = (lambda blobs: _packed_decode(blobs, modes)) if modes else (lambda blobs: list(map(one, blobs)))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(blobs: pd.Series) -> pd.Series:
        done = (np.asarray(x, np.int64) for x in many([x for x in blobs if x is not None]))
        return pd.Series([None if x is None else (np.cumsum(v) if with_gaps else v) for x, v in ((x, None if x is None else next(done)) for x in blobs)], dtype=object)

    return run(data)


def varbyte_size(value: Column) -> Column:
    """Bytes that VarByte takes for a value."""
    return F.when(value < 1 << 7, 1).when(value < 1 << 14, 2).when(value < 1 << 21, 3).when(value < 1 << 28, 4).otherwise(5)
