"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling.

Words and the characters in them are the inputs. A word's vector holds how much more often the word,
and each of its 3 to 5-grams of bytes, occurs in toxic than in clean labelled texts, and learned
embeddings of the word and of its n-grams. Overlapping windows of a text run through the network in
numpy, all of them, and the text's score is that of its worst window.

A label tells of a text, not of a window. So training takes, again and again, the worst window of each
toxic text as an example of toxic text, and of each clean text the worst and a random one as clean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from quern.llm.common import blocks, mix, release, span_hashes, spans, text_bytes

#: Labelled texts of each class that the model is fitted on, at most; those with the least hash.
FIT_ROWS = 1200
#: Bytes of the texts of each class that it is fitted on, at most; whole texts, in the same order. Texts of
#: over 1 / LONG of them come last, the shortest first, so that none of them can take the place of many.
FIT_BYTES = 6 << 20
LONG = 100
#: Texts of each class that it is fitted on whatever their bytes, if there are so many.
LEAST_ROWS = 10
WINDOW, STRIDE = 32, 16
HIDDEN, EMBED = 8, 4
#: Rows of the learned embeddings, and slots of the table of log-odds (a slot knows its key).
BUCKETS, SLOTS = 1 << 13, 1 << 20
THRESHOLD = 0.7
#: How fast learned embeddings fade, over the number of texts.
FADE = 600.0
GRAMS = (3, 4, 5)

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_INPUT = 3 + 2 * EMBED


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, starts and ends of words, and the first word of each text (one more at the end)."""
    data, offsets = text_bytes(pc.utf8_lower(texts.fill_null("")))
    start, end = spans(data, offsets, _APART)
    return data, start, end, np.searchsorted(start, offsets)


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the n-grams of each word; a word of fewer bytes is its own n-gram."""
    length = end - start
    total = int(length.sum())
    owner = np.repeat(np.arange(len(start)), length)
    first = np.cumsum(length) - length
    flat = data[np.arange(total) - np.repeat(first, length) + np.repeat(start, length)].astype(np.uint64)
    left = np.repeat(first + length, length) - np.arange(total)  # bytes from here to the word's end
    whole = np.repeat(length, length)
    owners, keys = [], []
    h = np.zeros(total, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h[: total - n + 1] = h[: total - n + 1] * np.uint64(257) + flat[n - 1 :] + np.uint64(1)
        at = np.flatnonzero(left >= n) if n in GRAMS else np.flatnonzero((left == n) & (whole == n))
        owners.append(owner[at])
        keys.append(mix(h[at] ^ np.uint64(n << 56)))
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return owner[order], key[order]


class LogOdds:
    """Log-odds by 64-bit key in a fixed number of slots. A slot keeps the key's tag, so another key finds 0."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, c: np.ndarray, n_toxic: int, n_clean: int, without: int | None = None) -> None:
        """keys, and how many toxic and clean texts have each. without: 1, as a toxic text's own keys are seen
        from the others (each key counts one toxic text less); 0, likewise a clean one's."""
        if without is not None:
            a, c = np.maximum(a - without, 0), np.maximum(c - (1 - without), 0)
        value = np.log((a + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
        value *= (a + c) / (a + c + 6.0)
        keep = np.flatnonzero((a + c >= 5) & (np.abs(value) > 0.5))
        keep = keep[np.argsort(np.abs(value[keep]), kind="stable")]  # in a shared slot the strongest stays
        slot = (keys[keep] % np.uint64(SLOTS)).astype(np.int64)
        self.tag, self.value = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.float32)
        self.tag[slot] = (keys[keep] >> np.uint64(32)).astype(np.uint32)
        self.value[slot] = value[keep]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys % np.uint64(SLOTS)).astype(np.int64)
        return np.where(self.tag[slot] == (keys >> np.uint64(32)).astype(np.uint32), self.value[slot], np.float32(0))


class Counts:
    """In how many toxic and clean texts each key occurs, block by block of texts."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.n = np.zeros((2, 0), np.int32)

    def add(self, keys: list[np.ndarray], y: np.ndarray) -> None:
        """keys: the distinct ones of each text; y: 1 for toxic texts."""
        for k in (0, 1):
            x = np.concatenate([np.zeros(0, np.uint64), *(x for x, v in zip(keys, y) if v == k)])
            x.sort()
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            found, times = x[first], np.diff(np.append(first, len(x)))
            every = np.union1d(self.keys, found)
            n = np.zeros((2, len(every)), np.int32)
            n[:, np.searchsorted(every, self.keys)] = self.n
            n[k, np.searchsorted(every, found)] += times.astype(np.int32)
            self.keys, self.n = every, n

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys that several texts have, toxic texts, clean texts)."""
        some = self.n.sum(0) > 1
        return self.keys[some], self.n[1, some], self.n[0, some]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def gru(inputs: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """Hidden states (steps, rows, HIDDEN) for gate inputs (steps, rows, 3 * HIDDEN). keep: gets what backward needs."""
    steps, rows, _ = inputs.shape
    out = np.empty((steps, rows, HIDDEN), np.float32)
    h = np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps):
        a, hu = inputs[t], h @ u
        zr = _sigmoid(a[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep is not None:
            keep.append((h, z, r, n, hu[:, 2 * HIDDEN :]))
        out[t] = h = new
    return out


def gru_back(d_out: np.ndarray, u: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of u."""
    steps, rows, _ = d_out.shape
    d_in, d_u, dh = np.zeros((steps, rows, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, hun = kept[t]
        dh = dh + d_out[t]
        m = mask[t][:, None]
        dn_ = np.where(m, dh, 0)
        d_n = dn_ * (1 - z) * (1 - n * n)
        d_z, d_r = dn_ * (h - n) * z * (1 - z), d_n * hun * r * (1 - r)
        d_hu = np.concatenate([d_z, d_r, d_n * r], 1)
        d_in[t] = np.concatenate([d_z, d_r, d_n], 1)
        d_u += h.T @ d_hu
        dh = np.where(m, 0, dh) + dn_ * z + d_hu @ u.T
    return d_in, d_u


class Model:
    """The network and its tables. Weights are a flat dict, so that the whole is shipped as it is."""

    def __init__(self, words: LogOdds, grams: LogOdds, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.words, self.grams = words, grams
        p = {"word": rng.normal(0, 0.05, (BUCKETS, EMBED)), "gram": rng.normal(0, 0.05, (BUCKETS, EMBED)), "pool": rng.normal(0, 0.3, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for side in ("f", "b"):
            p["w" + side] = rng.normal(0, 0.4, (_INPUT, 3 * HIDDEN))
            p["c" + side] = np.zeros(3 * HIDDEN)
            p["u" + side] = rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN))
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def features(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict:
        """Of each word with this hash: fixed inputs (rows, 3), embedding rows of the word, and of its n-grams."""
        owner, gram = _grams(data, start, end)
        odds = self.grams(gram)
        first = np.searchsorted(owner, np.arange(len(start)))
        count = np.bincount(owner, minlength=len(start)).astype(np.float32)
        fixed = np.stack([self.words(key), np.maximum.reduceat(odds, first), np.add.reduceat(odds, first) / count], 1)
        return {"fixed": np.clip(fixed / 4, -1.5, 1.5).astype(np.float32), "word": (key % np.uint64(BUCKETS)).astype(np.int64), "owner": owner.astype(np.int32), "gram": (gram % np.uint64(BUCKETS)).astype(np.int32), "first": first, "count": count[:, None]}

    def vectors(self, f: dict) -> np.ndarray:
        return np.concatenate([f["fixed"], self.p["word"][f["word"]], np.add.reduceat(self.p["gram"][f["gram"]], f["first"], axis=0) / f["count"]], 1).astype(np.float32)

    def run(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. x: vectors of words; ids, mask: (steps, windows). No mask: all steps count."""
        p = self.p
        kept: tuple[list, list] = ([], [])
        gates = [x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"]]
        hf = gru(gates[0][ids], p["uf"], mask, kept[0] if keep is not None else None)
        hb = gru(gates[1][ids[::-1]], p["ub"], None if mask is None else mask[::-1], kept[1] if keep is not None else None)[::-1]
        e = hf @ p["pool"][:HIDDEN] + hb @ p["pool"][HIDDEN:]
        if mask is not None:
            e = np.where(mask, e, -30)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        value = hf @ p["out"][:HIDDEN] + hb @ p["out"][HIDDEN:]
        logit = (alpha * value).sum(0) + p["bias"]
        if keep is not None:
            keep |= {"hf": hf, "hb": hb, "alpha": alpha, "value": value, "kept": kept}
        return logit

    def score(self, x: np.ndarray, ids: np.ndarray, lengths: np.ndarray, batch: int = 2048) -> np.ndarray:
        """Probabilities of windows (windows, WINDOW), batch by batch."""
        out = np.empty(len(ids), np.float32)
        for i in range(0, len(ids), batch):
            part, n = ids[i : i + batch], lengths[i : i + batch]
            mask = None if (n == WINDOW).all() else np.arange(WINDOW)[:, None] < n
            out[i : i + batch] = _sigmoid(self.run(x, np.ascontiguousarray(part.T), mask))
        return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of words) of all windows; a long text's last one ends with the text."""
    n = np.diff(first)
    many = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at = first[:-1][text] + np.minimum(k * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return text, at, np.minimum(n[text], WINDOW)


def _prepare(model: Model, texts: pa.Array) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of the distinct words; their place for each word; windows. Full windows come first."""
    data, start, end, first = _words(texts)
    key, one, ids = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    text, at, n = windows(first)
    order = np.argsort(n != WINDOW, kind="stable")
    text, at, n = text[order], at[order], n[order]
    grid = np.minimum(at[:, None] + np.arange(WINDOW), max(len(ids) - 1, 0)) if len(at) else np.zeros((0, WINDOW), np.int64)
    f = model.features(key, data, start[one], end[one]) if len(one) else {}
    return f, ids, grid, text, n


def score_texts(model: Model | float, texts: pa.Array) -> np.ndarray:
    """The score of each text; one without words has 0. A number as model: that for all others."""
    out = np.zeros(len(texts), np.float32)
    if isinstance(model, float):
        _, start, _, first = _words(texts)
        out[np.diff(first) > 0] = model
        return out
    f, ids, grid, text, n = _prepare(model, texts)
    if len(text):
        np.maximum.at(out, text, model.score(model.vectors(f), ids[grid], n))
    return out


def _keys(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct keys of words, and of n-grams, in each text."""
    data, start, end, first = _words(texts)
    h = span_hashes(data, start, end)
    owner, gram = _grams(data, start, end) if len(start) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    cut = np.searchsorted(owner, first)
    return [np.unique(h[i:j]) for i, j in zip(first, first[1:])], [np.unique(gram[i:j]) for i, j in zip(cut, cut[1:])]


def fit(texts: list[str | None], toxic: list[int], rounds: int = 5, epochs: int = 6, seed: int = 5) -> Model | float:
    """A model of labelled texts. With labels of one class only: their mean; without labels: 0."""
    y = np.array(toxic, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    array = pa.array(texts, pa.large_string())
    offsets = text_bytes(array)[1]
    words, grams = Counts(), Counts()
    for i, j in blocks(offsets, 1 << 20):
        for counts, keys in zip((words, grams), _keys(array.slice(i, j - i))):
            counts.add(keys, y[i:j])
    count = (int(y.sum()), int((1 - y).sum()))
    tables = {k: [LogOdds(*x.repeated(), *count, without=k) for x in (words, grams)] for k in (None, 0, 1)}
    del words, grams
    model = Model(*tables[None], seed)

    rng = np.random.default_rng(seed)
    parts = []
    for k in (1, 0):  # a text that is learned from mustn't see its own label in its inputs
        own = np.flatnonzero(y == k)
        group = array.take(pa.array(own))
        seen = Model(*tables[k], seed)
        for i, j in blocks(text_bytes(group)[1]):
            f, ids, grid, text, n = _prepare(seen, group.slice(i, j - i))
            if len(text):
                parts.append((f, ids[grid].astype(np.int32), own[text + i], n))
    if not parts:
        return float(y.mean())
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    for turn in range(rounds):
        rows: list[tuple[dict, np.ndarray, np.ndarray, np.ndarray]] = []
        for f, ids, text, n in parts:
            # At first a window is as bad as the log-odds of its n-grams.
            s = f["fixed"][:, 1][ids].max(1) + f["fixed"][:, 1][ids].mean(1) if turn == 0 else model.score(model.vectors(f), ids, n)
            order = np.lexsort((-s, text))
            lead = np.ones(len(order), bool)
            lead[1:] = text[order][1:] != text[order][:-1]
            pick = order[lead]
            some = rng.permutation(len(order))
            _, one = np.unique(text[some], return_index=True)
            extra = some[one]
            pick = np.unique(np.concatenate([pick, extra[y[text[extra]] == 0]]))
            grid, size, target = ids[pick], n[pick], y[text[pick]]
            if target[0] == 0:
                # A clean text's word is clean however often it is repeated; few real windows would say so.
                again = rng.choice(grid.reshape(-1), max(1, len(grid) // 4))
                grid = np.concatenate([grid, np.repeat(again[:, None], WINDOW, axis=1)])
                size, target = np.concatenate([size, np.full(len(again), WINDOW)]), np.concatenate([target, np.zeros(len(again), np.float32)])
            used, where = np.unique(grid, return_inverse=True)
            rows.append((_take(f, used), where.reshape(-1, WINDOW), size, target))
        f, ids, n, target = _merge(rows)
        batches = -(-len(ids) // 256)
        for _ in range(max(epochs, -(-100 // batches))):
            for take in np.array_split(rng.permutation(len(ids)), batches):
                step += 1
                used, where = np.unique(ids[take], return_inverse=True)
                _train(model, _take(f, used), where.reshape(-1, WINDOW).T, n[take], target[take], state, step, FADE / len(y))
    return model


def _take(f: dict, rows: np.ndarray) -> dict:
    """The features of some of the words."""
    count = f["count"][rows, 0].astype(np.int64)
    first = np.cumsum(count) - count
    at = np.arange(int(count.sum())) - np.repeat(first - f["first"][rows], count)
    return {"fixed": f["fixed"][rows], "word": f["word"][rows], "owner": np.repeat(np.arange(len(rows)), count), "gram": f["gram"][at], "first": first, "count": f["count"][rows]}


def _merge(rows: list[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of windows as one."""
    words = np.cumsum([0, *(len(r[0]["word"]) for r in rows)])
    grams = np.cumsum([0, *(len(r[0]["gram"]) for r in rows)])
    f = {k: np.concatenate([r[0][k] for r in rows]) for k in ("fixed", "word", "gram", "count")}
    f["owner"] = np.concatenate([r[0]["owner"] + w for r, w in zip(rows, words)])
    f["first"] = np.concatenate([r[0]["first"] + g for r, g in zip(rows, grams)])
    return f, np.concatenate([r[1] + w for r, w in zip(rows, words)]), np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])


def _train(model: Model, f: dict, where: np.ndarray, n: np.ndarray, y: np.ndarray, state: dict, step: int, fade: float, rate: float = 0.006) -> None:
    """One step of Adam on windows; classes weigh the same."""
    p = model.p
    x = model.vectors(f)
    mask = np.arange(WINDOW)[:, None] < n
    kept: dict = {}
    logit = model.run(x, where, mask, kept)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    d = (_sigmoid(logit) - y) * weight
    g = {"bias": np.array([d.sum()])}
    alpha, value, hf, hb = kept["alpha"], kept["value"], kept["hf"], kept["hb"]
    d_value = alpha * d
    d_e = alpha * (value - (alpha * value).sum(0)) * d
    g["out"] = np.concatenate([np.einsum("tb,tbh->h", d_value, h) for h in (hf, hb)])
    g["pool"] = np.concatenate([np.einsum("tb,tbh->h", d_e, h) for h in (hf, hb)])
    d_x = np.zeros_like(x)
    for side, h0 in (("f", 0), ("b", HIDDEN)):
        d_h = d_value[..., None] * p["out"][h0 : h0 + HIDDEN] + d_e[..., None] * p["pool"][h0 : h0 + HIDDEN]
        m, w = (mask, where) if side == "f" else (mask[::-1], where[::-1])
        d_in, g["u" + side] = gru_back(d_h if side == "f" else d_h[::-1], p["u" + side], m, kept["kept"][side == "b"])
        d_in = d_in.reshape(-1, 3 * HIDDEN)
        by_word = np.zeros((len(x), 3 * HIDDEN), np.float32)
        np.add.at(by_word, w.reshape(-1), d_in)
        g["w" + side], g["c" + side] = x.T @ by_word, by_word.sum(0)
        d_x += by_word @ p["w" + side].T
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(g["word"], f["word"], d_x[:, 3 : 3 + EMBED])
    np.add.at(g["gram"], f["gram"], (d_x[:, 3 + EMBED :] / f["count"])[f["owner"]])
    for k, grad in g.items():
        m1, m2 = state[k]
        m1 += 0.1 * (grad - m1)
        m2 += 0.01 * (grad * grad - m2)
        p[k] -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        if k != "bias":  # fewer texts say less about words, so what is learned of these fades faster
            p[k] *= np.float32(1 - rate * (fade if k in ("word", "gram") else 0.02))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a null identifier isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_labels(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, most_bytes: int = FIT_BYTES, text: str = "text", doc_id: str = "doc_id") -> Model | float:
    """A model of at most `most` toxic and `most` clean labelled texts that aren't held out: those whose
    identifiers have the least hash. Of each class they have at most most_bytes, unless LEAST_ROWS texts
    have more; long texts give way to others. Rows without text or label are left out."""
    ok = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ok = ok.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(3), "doc_id")
    chosen = None
    for k in (0, 1):
        part = ok.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # At most 2 * most rows, so the broadcast is bounded; of repeated rows one is learned from.
    found = body.join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull()).groupBy("doc_id").agg(F.min_by("text", F.struct(F.length("text"), "text")).alias("text"), F.max("toxic").alias("toxic"))
    size = F.octet_length("text").cast("long")
    in_turn = Window.partitionBy("toxic").orderBy(F.when(size * LONG > most_bytes, size).otherwise(0), order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("so_far", F.sum(size).over(in_turn)).withColumn("place", F.count("*").over(in_turn))
    rows = sorted(found.filter((F.col("so_far") <= most_bytes) | (F.col("place") <= LEAST_ROWS)).select("doc_id", "text", "toxic").collect(), key=lambda r: r["doc_id"])
    model = fit([r["text"] for r in rows], [r["toxic"] for r in rows])
    release()
    return model


def _scored(model: Model | float, place: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(place)
            _, offsets = text_bytes(column)
            got = [score_texts(model, column.slice(i, j - i)) for i, j in blocks(offsets)]
            s = np.concatenate(got).astype(np.float64) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "_score"])
        release()

    return score


def score_docs(docs: DataFrame, model: Model | float, text: str = "text") -> DataFrame:
    """docs, of which text is a string, with a column _score from 0 to 1; a null text, or one without
    words, has 0. No shuffle. docs mustn't have a column _score."""
    schema = StructType([*docs.schema.fields]).add("_score", DoubleType())
    return docs.mapInArrow(_scored(model, docs.columns.index(text)), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Only the text is an input of a score, so repeated rows score alike. A null or empty text, and one without words,
    has 0; a very long one has the score of its worst window, of all its windows. Of labelled rows that repeat an
    identifier, the one with the shortest text, of these the least, is learned from, and an identifier that any row
    labels toxic is toxic. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    model = fit_labels(docs, labels, text=text, doc_id=doc_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = score_docs(rows, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
