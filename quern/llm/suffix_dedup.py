"""Removal of repeated byte strings by prefix-free parsing and suffix order.

Triggers cut each text into phrases. A trigger is a place whose rolling hash of TRIGGER bytes is the
least among those of some LENGTH-byte string, so each such string (a window) has exactly one, its first
phrase border, at a distance that only its own bytes decide; the string's part before the trigger is a
phrase's suffix, its part from the trigger on is a prefix of the rest of the parse. Windows are equal
if and only if these two parts are.

1. Trigger strings are counted over the corpus by hash. A window whose trigger string occurs once is
   unique, and drops out here, as most of a corpus does.
2. For each other trigger its phrase and what follows, as bytes, meet those of equal trigger strings.
   There the right sides are sorted (the suffix array of the parse, as far as LENGTH bytes), the left
   sides are sorted from the trigger backwards (that of the dictionary), and both arrays' longest common
   prefixes give for each length a class of equal strings. A window is the pair of a left and a right class,
   so equal windows are found from exact comparisons of bytes, not of hashes.
3. The windows that occur elsewhere go back to their texts, where the bytes they cover are removed.

What departs from the method: neither the dictionary of all phrases nor the parse as numbers is stored, and both
suffix orders exist only in pieces, one for each trigger string that occurs again, and LENGTH bytes deep.
Whether a window occurs elsewhere asks for no more, and most phrases of a corpus occur once: their order among
all others would be the dearest part of it.

Equal phrases with equal surroundings in one task's texts are one row from the start, so passages that
a third of all rows share cost one row a task. A trigger string that occurs over CAP times doesn't meet as one
group, whatever is around it: its windows are counted one by one, told apart by 128 bits of two hashes. Of
these, a task tells its texts at once of windows that it sees twice, and sends on one row for each window.

Each text has a number, which is written down with it, so rows that are alike are still each their own. Texts
are written once, compressed and in buckets by number, and every join with them reads the buckets as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import bounded_broadcast, bucketed, materialize, mix, powers, text_bytes

LENGTH, TRIGGER = 200, 24
#: Places of a trigger in a window.
PLACES = LENGTH - TRIGGER + 1
#: Bytes of text parsed together, triggers (or windows) of texts a task dedups together, rows sorted together, occurrences of a trigger string up to which they meet.
PIECE, HELD, SORTED, CAP = 1 << 20, 1 << 20, 16_000, 20_000
#: Hot trigger strings that may be broadcast; more are joined by a shuffle with salt.
BROADCAST_HOT, SALT = 500_000, 32

_INT = np.int64


class Piece:
    """Texts, or a part of a long one, parsed together: data, and the first and last window start + 1 of
    each text in it. row, base: the text, and the place of data's first byte of it in the text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int, base: int, low: np.ndarray, high: np.ndarray) -> None:
        self.data, self.offsets, self.row, self.base, self.low, self.high = data, offsets, row, base, low, high


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, size: int = PIECE) -> Iterator[Piece]:
    """All texts; one of over `size` bytes comes in parts that overlap, each window in exactly one part."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > size:
            a, b = int(offsets[i]), int(offsets[i + 1])
            starts = b - a - length + 1
            for lo in range(0, max(starts, 0), size):
                hi = min(starts, lo + size)
                yield Piece(data[a + lo : a + hi + length - 1], np.array([0, hi - lo + length - 1]), i, lo, np.array([0]), np.array([hi - lo]))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        long = np.flatnonzero(np.diff(offsets[i : j + 1]) > size)
        j = min(j, i + int(long[0])) if len(long) else j
        at = offsets[i : j + 1] - offsets[i]
        yield Piece(data[offsets[i] : offsets[j]], at, i, 0, at[:-1], np.maximum(at[1:] - length + 1, at[:-1]))
        i = j


def triggers(p: Piece, length: int = LENGTH, width: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, first window start, last window start, hash of the trigger string) for each trigger with windows; places in p.data."""
    n = len(p.data)
    none = np.zeros(0, _INT)
    if n < length or not (p.high > p.low).any():
        return none, none, none, none, np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((p.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = total[width:] - total[:-width]
    h *= down[: n - width + 1]
    h = mix(h)
    # The least hash, leftmost on ties, among the places of each window, by doubling.
    order = (h & ~np.uint64(0x1FFFFFF)) | np.arange(len(h), dtype=np.uint64)
    if n >= 1 << 25:
        raise ValueError("a piece must be shorter")
    places, span = length - width + 1, 1
    least = order
    while span * 2 <= places:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < places:
        least = np.minimum(least[: n - length + 1], least[places - span : places - span + n - length + 1])
    trigger = (least & np.uint64(0x1FFFFFF)).astype(_INT)
    # Windows that begin in a text and end in it.
    valid = np.zeros(len(trigger) + 1, np.int8)
    some = p.high > p.low
    np.add.at(valid, p.low[some], 1)
    np.add.at(valid, p.high[some], -1)
    start = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    t = trigger[start]
    text = np.searchsorted(p.offsets, start, "right") - 1
    lead = np.ones(len(t), bool)
    lead[1:] = (t[1:] != t[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(lead)
    last = np.append(first[1:], len(t)) - 1
    return text[first], t[first], start[first], start[last], h[t[first]]


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The strings data[start:start + length] as binary values."""
    offsets = np.zeros(len(start) + 1, _INT)
    np.cumsum(length, out=offsets[1:])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, length)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


_COUNTED = "key long, ref long, n long, local boolean"


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of compressed texts."""
    decompress = zstandard.ZstdDecompressor().decompress
    texts = [decompress(x) for x in column.to_pylist()]
    offsets = np.zeros(len(texts) + 1, _INT)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref, body) -> key, ref, n, local. Of a key that several texts of the task have, or one has twice,
    each text learns at once (local) and one row goes on to the count."""
    keys: list[np.ndarray] = []
    refs: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, ref = np.concatenate(keys), np.concatenate(refs)
        order = np.argsort(key, kind="stable")
        key, ref = key[order], ref[order]
        lead = np.ones(len(key), bool)
        lead[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(lead)
        n = np.diff(np.append(first, len(key)))
        again = np.repeat(n > 1, n)
        key_l, ref_l = key[again], ref[again]
        fresh = np.ones(len(key_l), bool)
        fresh[1:] = (key_l[1:] != key_l[:-1]) | (ref_l[1:] != ref_l[:-1])
        key_l, ref_l = key_l[fresh], ref_l[fresh]
        columns = (np.concatenate([key[first], key_l]), np.concatenate([ref[first], ref_l]), np.concatenate([n, np.zeros(len(key_l), _INT)]), np.arange(len(first) + len(key_l)) >= len(first))
        yield from pa.Table.from_arrays([pa.array(columns[0].view(_INT)), *map(pa.array, columns[1:])], names=["key", "ref", "n", "local"]).to_batches(max_chunksize=100_000)

    for b in batches:
        data, offsets = _unpacked(b.column(1))
        ref = b.column(0).to_numpy()
        for p in pieces(data, offsets):
            text, _, _, _, key = triggers(p)
            keys.append(key)
            refs.append(ref[text + p.row])
            held += len(key)
            if held >= HELD:
                yield from flush()
                keys.clear()
                refs.clear()
                held = 0
    if held:
        yield from flush()


def _repeated_rows(cap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows of _count_rows -> (ref, key, hot) of each text with a repeated key. At most one row of a
    task has a key, so the rows held back, those of a batch's last key, are no more than tasks."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, _INT)] * 3

        def out(key: np.ndarray, ref: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            lead = np.ones(len(key), bool)
            lead[1:] = key[1:] != key[:-1]
            total = np.add.reduceat(n, np.flatnonzero(lead))[np.cumsum(lead) - 1] if len(key) else n
            at = np.flatnonzero(total > 1)
            return pa.RecordBatch.from_arrays([pa.array(ref[at]), pa.array(key[at]), pa.array(total[at] > cap)], names=["ref", "key", "hot"])

        for b in batches:
            key, ref, n = (b.column(i).to_numpy() for i in range(3))
            local = b.column(3).to_numpy(zero_copy_only=False)
            if local.any():
                yield pa.RecordBatch.from_arrays([pa.array(ref[local]), pa.array(key[local]), pa.array(np.zeros(int(local.sum()), bool))], names=["ref", "key", "hot"])
                key, ref, n = key[~local], ref[~local], n[~local]
            key, ref, n = (np.concatenate([h, x]) for h, x in zip(held, (key, ref, n)))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            yield out(key[:cut], ref[:cut], n[:cut])
            held = [key[cut:], ref[cut:], n[cut:]]
        yield out(*held)

    return repeated


#: key and what of the text is met under it; left: bytes before the trigger; n: 2 if it stands for several.
_MET = "key long, ref long, start long, windows int, left int, n int, body binary"


def _meeting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref, body, keys) -> _MET rows of triggers with these strings. Rows with n = 0 and no body
    tell a text of windows that the task itself has found elsewhere."""
    parts: list[tuple[np.ndarray, ...]] = []
    bodies: list[pa.Array] = []
    held = 0
    decompress = zstandard.ZstdDecompressor().decompress

    def flush() -> Iterator[pa.RecordBatch]:
        key, ref, start, windows, left, same = (np.concatenate(x) for x in zip(*parts))
        body = pa.chunked_array(bodies).combine_chunks()
        order = np.lexsort((same, key))
        lead = np.ones(len(order), bool)
        k, s = key[order], same[order]
        lead[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        # Equal hashes here only propose: each is compared with the first of its run.
        group = order[lead][np.cumsum(lead) - 1]
        n = np.ones(len(key), np.int32)
        drop = np.zeros(len(key), bool)
        for i, g in zip(order[~lead].tolist(), group[~lead].tolist()):
            if windows[i] == windows[g] and left[i] == left[g] and body[i].as_buffer() == body[g].as_buffer():
                drop[i], n[g] = True, 2
        keep = np.flatnonzero(~drop)
        known = np.flatnonzero(drop)
        table = pa.Table.from_arrays(
            [pa.array(key[keep]), pa.array(ref[keep]), pa.array(start[keep]), pa.array(windows[keep].astype(np.int32)), pa.array(left[keep].astype(np.int32)), pa.array(n[keep]), body.take(pa.array(keep)).cast(pa.binary())],
            names=["key", "ref", "start", "windows", "left", "n", "body"],
        )
        yield from table.to_batches(max_chunksize=20_000)
        if len(known):
            zero = pa.array(np.zeros(len(known), np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(ref[known].astype(np.uint64)).view(_INT)), pa.array(ref[known]), pa.array(start[known]), pa.array(windows[known].astype(np.int32)), zero, zero, pa.array([b""] * len(known), pa.binary())],
                names=["key", "ref", "start", "windows", "left", "n", "body"],
            )

    for b in batches:
        for ref, packed, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            wanted = np.unique(keys.values.to_numpy().view(np.uint64))
            data = np.frombuffer(decompress(packed), np.uint8)
            for p in pieces(data, np.array([0, len(data)])):
                _, t, lo, hi, key = triggers(p)
                at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                pick = np.flatnonzero(wanted[at] == key)
                t, lo, hi, key = t[pick], lo[pick], hi[pick], key[pick]
                if not len(key):
                    continue
                length = hi - lo + LENGTH
                total = np.zeros(len(p.data) + 1, np.uint64)
                up, down = powers(len(p.data) + 1)
                np.cumsum((p.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
                same = mix(((total[lo + length] - total[lo]) * down[lo]) ^ ((t - lo).astype(np.uint64) << np.uint64(16)) ^ length.astype(np.uint64))
                parts.append((key.view(_INT), np.full(len(key), ref), lo + p.base, hi - lo + 1, t - lo, same))
                bodies.append(gather(p.data, lo, length))
                held += int(length.sum())
                if held >= 24 << 20:
                    yield from flush()
                    parts.clear()
                    bodies.clear()
                    held = 0
    if parts:
        yield from flush()


#: Windows of hot triggers. n: how many windows of a task's texts the row stands for; 0: a run of count windows that occur elsewhere.
_WINDOW = "k1 long, k2 long, ref long, start long, count int, n int"


def window_hashes(data: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each data[start:start + length]: of the whole, and of its quarters."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    part = lambda a, b: mix((total[b] - total[a]) * down[a])
    second = np.zeros(len(start), np.uint64)
    for i in range(4):
        second = mix(second + part(start + i * length // 4, start + (i + 1) * length // 4) + np.uint64(i + 1))
    return part(start, start + length), second


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref, body, hot) -> _WINDOW rows of the windows of hot triggers. Windows that the task sees twice are told to
    their texts at once, and one row goes on."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0
    names = ["k1", "k2", "ref", "start", "count", "n"]

    def flush() -> Iterator[pa.RecordBatch]:
        k1, k2, ref, start = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((k2, k1))
        k1, k2, ref, start = k1[order], k2[order], ref[order], start[order]
        lead = np.ones(len(k1), bool)
        lead[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        first = np.flatnonzero(lead)
        n = np.diff(np.append(first, len(k1)))
        again = np.repeat(n > 1, n)
        r, s = ref[again], start[again]
        by = np.lexsort((s, r))
        r, s = r[by], s[by]
        edge = np.ones(len(r), bool)
        edge[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
        at = np.flatnonzero(edge)
        runs = (mix(r[at].astype(np.uint64)), np.zeros(len(at), np.uint64), r[at], s[at], np.diff(np.append(at, len(r))), np.zeros(len(at), _INT))
        counts = (k1[first], k2[first], ref[first], start[first], np.ones(len(first), _INT), n)
        columns = [np.concatenate(x) for x in zip(counts, runs)]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2
        yield from pa.Table.from_arrays([pa.array(c.view(_INT), pa.int64()).cast(k) for c, k in zip(columns, kinds)], names=names).to_batches(max_chunksize=100_000)

    for b in batches:
        data, offsets = _unpacked(b.column(1))
        ref, hot = b.column(0).to_numpy(), [np.sort(h.values.to_numpy().view(np.uint64)) for h in b.column(2)]
        for p in pieces(data, offsets):
            text, _, lo, hi, key = triggers(p)
            pick = np.zeros(len(key), bool)
            for x in np.unique(text).tolist():
                own = slice(*np.searchsorted(text, [x, x + 1]))
                pick[own] = np.isin(key[own], hot[p.row + x])
            if not pick.any():
                continue
            text, lo, many = text[pick], lo[pick], (hi - lo + 1)[pick]
            at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            text = np.repeat(text, many)
            parts.append((*window_hashes(p.data, at), ref[text + p.row], at - p.offsets[text] + p.base))
            held += len(at)
            if held >= HELD:
                yield from flush()
                parts.clear()
                held = 0
    if parts:
        yield from flush()


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_WINDOW rows sorted by hashes -> ref, start, count: runs of windows that occur elsewhere. One task's flush has one
    row of a window, so few rows are held back."""
    held: pa.Table | None = None

    def out(t: pa.Table) -> pa.RecordBatch:
        k1, k2, ref, start, count, n = (c.to_numpy() for c in t.columns)
        lead = np.ones(len(k1), bool)
        lead[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        total = np.add.reduceat(n, np.flatnonzero(lead))[np.cumsum(lead) - 1] if len(n) else n
        at = np.flatnonzero((total > 1) & (n == 1))  # the others know already
        return pa.RecordBatch.from_arrays([pa.array(ref[at]), pa.array(start[at]), pa.array(count[at])], names=["ref", "start", "count"])

    for b in batches:
        t = pa.Table.from_batches([b])
        n = t["n"].to_numpy()
        if (n == 0).any():
            yield from t.filter(pa.array(n == 0)).select(["ref", "start", "count"]).to_batches()
            t = t.filter(pa.array(n > 0))
        if not len(t):
            continue
        t = pa.concat_tables([held, t]) if held is not None else t
        k1 = t["k1"].to_numpy()
        cut = int(np.searchsorted(k1, k1[-1]))
        yield out(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None:
        yield out(held)


def _classes(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows in lexicographic order within each key, and the bytes each has in common with
    the one before it (-1: another key). A suffix array and its longest common prefixes."""
    wide = np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), rows], 1)
    order = np.argsort(np.ascontiguousarray(wide).view(f"S{wide.shape[1]}").reshape(-1), kind="stable")
    differs = rows[order[1:]] != rows[order[:-1]]
    common = np.full(len(order), -1, np.int16)
    common[1:] = np.where(key[order[1:]] != key[order[:-1]], -1, np.where(differs.any(1), differs.argmax(1), rows.shape[1]))
    return order, common


def equal_windows(key: np.ndarray, windows: np.ndarray, left: np.ndarray, n: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, places: int = PLACES) -> np.ndarray:
    """(rows, places): whether the row's window with the trigger at that distance occurs elsewhere."""
    m = len(key)
    size = np.diff(offsets)
    far = left[:, None] - np.arange(1, places + 1)
    rev = np.where(far >= 0, data[np.minimum(offsets[:-1, None] + np.maximum(far, 0), len(data) - 1)], 0).astype(np.uint8)
    at = left[:, None] + np.arange(length)
    right = np.where(at < size[:, None], data[np.minimum(offsets[:-1, None] + at, len(data) - 1)], 0).astype(np.uint8)
    order_r, common_r = _classes(right, key)
    order_l, common_l = _classes(rev, key)
    most, least = left, left - windows + 1
    hit = np.zeros((m, places), bool)
    rank_r, rank_l = np.empty(m, _INT), np.empty(m, _INT)
    for o in range(int(least.min()), min(int(most.max()), places - 1) + 1):
        rows = np.flatnonzero((least <= o) & (o <= most))
        if not len(rows):
            continue
        rank_r[order_r] = np.cumsum(common_r < length - o)
        rank_l[order_l] = np.cumsum(common_l < o)
        code = rank_l[rows] * (m + 1) + rank_r[rows]
        by = np.argsort(code)
        sorted_ = code[by]
        same = sorted_[1:] == sorted_[:-1]
        again = np.zeros(len(rows), bool)
        again[by[1:][same]] = True
        again[by[:-1][same]] = True
        hit[rows, o] = again | (n[rows] > 1)
    return hit


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted _MET rows -> ref, start, count: runs of windows that occur elsewhere."""
    names = ["ref", "start", "count"]

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        key, ref, start, windows, left, n = (t[c].to_numpy() for c in ("key", "ref", "start", "windows", "left", "n"))
        body = t["body"].combine_chunks() if isinstance(t["body"], pa.ChunkedArray) else t["body"]
        body = body.cast(pa.large_binary())
        offsets = np.frombuffer(body.buffers()[1], _INT)[body.offset : body.offset + len(body) + 1]
        data = np.frombuffer(body.buffers()[2], np.uint8)
        hit = equal_windows(key, windows.astype(_INT), left.astype(_INT), n, data, offsets)
        # Distance o is the window that starts at start + left - o, so runs go backwards.
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        first = start[row] + left[row] - (b - 1)
        return pa.RecordBatch.from_arrays([pa.array(ref[row]), pa.array(first), pa.array((b - a).astype(np.int32))], names=names)

    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        t = pa.Table.from_batches([b])
        n = t["n"].to_numpy()
        if (n == 0).any():
            known = t.filter(pa.array(n == 0))
            yield from known.select(["ref", "start", "windows"]).rename_columns(names).to_batches()
            t = t.filter(pa.array(n > 0))
        if not len(t):
            continue
        held.append(t)
        rows += len(t)
        if rows >= SORTED:
            t = pa.concat_tables(held)
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield solve(t.slice(0, cut))
            held = [t.slice(cut)]
            rows = len(t) - cut
    if rows:
        yield solve(pa.concat_tables(held))


def covered(n: int, start: np.ndarray, count: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of n bytes the windows [start, start + count) cover."""
    edge = np.zeros(n + 1, _INT)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut_rows(with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, body, starts, counts) -> what is left of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            size, removed, spans, digest, kept = [], [], [], [], []
            for packed, start, count in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                body = decompress(packed)
                gone = 0
                runs = 0
                if start.is_valid and len(start.values):
                    flag = covered(len(body), start.values.to_numpy().astype(_INT), count.values.to_numpy().astype(_INT))
                    gone = int(flag.sum())
                    runs = int(np.count_nonzero(np.diff(np.concatenate([[0], flag.astype(np.int8)])) == 1))
                    size.append(len(body))
                    body = np.frombuffer(body, np.uint8)[~flag].tobytes()
                else:
                    size.append(len(body))
                removed.append(gone)
                spans.append(runs)
                digest.append(hashlib.sha256(body).hexdigest())
                kept.append(body)
            columns = [b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses texts, so that less of them is written."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "body"])


def _with_hot(repeated: DataFrame) -> tuple[DataFrame, bool]:
    """repeated with hot right in all rows of a key: a task's own rows don't know it. And whether any is."""
    hot = materialize(repeated.filter("hot").select("key").distinct(), "hot")
    if not hot.limit(1).count():
        return repeated, False
    few, known = bounded_broadcast(hot.withColumn("found", F.lit(True)), BROADCAST_HOT)
    if few:
        out = repeated.join(known, "key", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = repeated.withColumn("salt", F.pmod(F.xxhash64("ref"), F.lit(SALT)).cast("int")).join(salted, ["key", "salt"], "left")
    return out.select("ref", "key", F.col("found").isNotNull().alias("hot")), True


def remove_repeats(docs: DataFrame, with_text: bool = True, cap: int = CAP, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (bytes).

    A null text counts as empty; a text of under LENGTH bytes keeps all. Repeated rows, as copies of each
    other, lose all bytes that a window covers. A very long text is parsed in parts that overlap, and has all its
    windows compared. A cut may split a character: what is left are bytes. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = rows.mapInArrow(_packed, "doc_id long, body binary").withColumn("ref", F.monotonically_increasing_id())
    packed = bucketed(packed, "packed", "ref")
    counted = packed.select("ref", "body").mapInArrow(_count_rows, _COUNTED)
    repeated = counted.repartition(F.when(F.col("local"), F.xxhash64("key", "ref")).otherwise(F.col("key"))).sortWithinPartitions("key").mapInArrow(_repeated_rows(cap), "ref long, key long, hot boolean")
    repeated, some_hot = _with_hot(materialize(repeated, "repeated"))
    of_ref = lambda which: repeated.filter(which).groupBy("ref").agg(F.collect_set("key").alias("keys"))
    met = packed.select("ref", "body").join(of_ref(~F.col("hot")), "ref").select("ref", "body", "keys").mapInArrow(_meeting_rows, _MET)
    runs = met.repartition("key").sortWithinPartitions("key").mapInArrow(_runs, "ref long, start long, count int")
    if some_hot:
        hot = packed.select("ref", "body").join(of_ref(F.col("hot")), "ref").select("ref", "body", "keys").mapInArrow(_window_rows, _WINDOW)
        runs = runs.unionByName(hot.repartition("k1").sortWithinPartitions("k1", "k2").mapInArrow(_repeated_windows, "ref long, start long, count int"))
    found = runs.groupBy("ref").agg(F.collect_list(F.struct("start", "count")).alias("r"))
    found = found.select("ref", F.col("r.start").alias("starts"), F.col("r.count").alias("counts"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return packed.join(found, "ref", "left").select("doc_id", "body", "starts", "counts").mapInArrow(_cut_rows(with_text), schema)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
