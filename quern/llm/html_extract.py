"""Main text of web pages: a bidirectional LSTM labels the blocks of a page.

A page is read as its sequence of leaf blocks, each with the path of tags, classes and identifiers around
it, its words and a few measures. Hashed path and word tokens have learned vectors; the network runs over
the whole page in both directions, so a block's label rests on all others. It is written in numpy and
trained on pages that a generator here makes, of many layouts, with known labels.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul ins iframe".split()
)
#: What stands in these is no text of the page.
HIDDEN = frozenset("script style head title noscript template svg textarea".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: An open tag that ends when one of these begins.
CLOSES = {"p": BLOCK_TAGS, "li": frozenset(["li"]), "td": frozenset("td th tr".split()), "th": frozenset("td th tr".split()), "tr": frozenset(["tr"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "option": frozenset(["option"]), "head": frozenset(["body"])}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

TOKENS, PATH_DIM, WORD_DIM, MEASURES, HIDDEN_DIM = 1 << 12, 12, 6, 6, 16
_INPUT = PATH_DIM + WORD_DIM + MEASURES


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def _labels(tag: str, attributes: str) -> str:
    names = {x.lower() for _, a, b, c in _NAMES.findall(attributes) for x in _PARTS.findall(a or b or c)} if "=" in attributes else ()
    return " ".join([tag, *sorted(names)])


def page_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with character references decoded and white space collapsed."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[tuple[str, bool]] = []
    links = 0
    hidden = 0

    def end_block() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = sum(len(p) for p, in_link in parts if in_link)
                out.append(Block(tuple(x for _, x in stack), text, linked))
            parts.clear()

    def close(tag: str) -> None:
        nonlocal hidden
        if any(t == tag for t, _ in stack):
            while True:
                t, _ = stack.pop()
                hidden -= t in HIDDEN
                if t == tag:
                    return

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else n
        if stop > at and not hidden:
            parts.append((html.unescape(page[at:stop]), links > 0))
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK_TAGS or tag in HIDDEN:
                end_block()
                close(tag)
            elif tag == "br":
                parts.append((" ", False))
            continue
        if tag in VOID:
            if tag == "br" and not hidden:
                parts.append((" ", False))
            elif tag == "hr":
                end_block()
            continue
        if tag == "a":
            links += 1
        elif tag in BLOCK_TAGS or tag in HIDDEN:
            end_block()
            links = 0
            while stack and tag in CLOSES.get(stack[-1][0], ()):
                hidden -= stack.pop()[0] in HIDDEN
            if (m.group(3) or "").endswith("/") and tag == "iframe":
                continue
            stack.append((tag, _labels(tag, m.group(3) or "")))
            hidden += tag in HIDDEN
            if tag in RAW:
                found = re.compile(rf"</{tag}\b", re.I).search(page, at)
                at = found.start() if found else n
    end_block()
    return out


@lru_cache(maxsize=200_000)
def _token(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind}:{word}".encode()) % TOKENS


@lru_cache(maxsize=50_000)
def _path_tokens(path: tuple[str, ...]) -> tuple[int, ...]:
    """The leaf's tag, tags of all ancestors, and their names."""
    found = {_token("leaf", path[-1].split(" ")[0])} if path else {_token("leaf", "")}
    for step in path:
        tag, *names = step.split(" ")
        found.add(_token("tag", tag))
        for x in names:
            found.add(_token("name", x))
    return tuple(sorted(found))


_WORDS = re.compile(r"[^\W\d_]+|[©|»›@]")


def page_features(blocks: list[Block]) -> tuple[list[tuple[int, ...]], list[list[int]], np.ndarray]:
    """Path tokens, word tokens and measures of each block."""
    paths, words = [], []
    measures = np.zeros((len(blocks), MEASURES), np.float32)
    for i, b in enumerate(blocks):
        paths.append(_path_tokens(b.path))
        found = _WORDS.findall(b.text.lower())
        words.append([_token("word", w) for w in found] or [_token("word", "")])
        n = len(b.text)
        ends = b.text.count(". ") + b.text.count("! ") + b.text.count("? ") + (b.text[-1] in ".!?")
        measures[i] = (np.log1p(len(found)) / 4, min(1.0, b.linked / n), min(1.0, ends / 3), i / len(blocks), b.text[-1] in ".!?", np.log1p(len(blocks)) / 5)
    return paths, words, measures


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Token vectors, one LSTM for each direction, and a logistic output."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        p = {"path": rng.normal(0, 0.1, (TOKENS, PATH_DIM)), "word": rng.normal(0, 0.1, (TOKENS, WORD_DIM)), "out": rng.normal(0, 0.2, 2 * HIDDEN_DIM), "bias": np.zeros(1)}
        for side in "fb":
            p["w" + side] = rng.normal(0, 0.3, (_INPUT, 4 * HIDDEN_DIM))
            p["u" + side] = rng.normal(0, 0.2, (HIDDEN_DIM, 4 * HIDDEN_DIM))
            p["c" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN_DIM)  # input, forget, output gates, candidate
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    @staticmethod
    def flat(tokens: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all tokens, first of each block, how many each has)."""
        count = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.fromiter((t for ts in tokens for t in ts), np.int64, int(count.sum())), np.cumsum(count) - count, count

    def inputs(self, path: tuple, word: tuple, measures: np.ndarray) -> np.ndarray:
        return np.concatenate(
            [np.add.reduceat(self.p["path"][path[0]], path[1], axis=0), np.add.reduceat(self.p["word"][word[0]], word[1], axis=0) / np.sqrt(word[2])[:, None], measures], 1
        ).astype(np.float32)

    def lstm(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """x: (steps, pages, _INPUT)."""
        p, d = self.p, HIDDEN_DIM
        gates = x @ p["w" + side] + p["c" + side]
        steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((x.shape[1], d), np.float32)
        c = np.zeros_like(h)
        out = np.empty((len(x), x.shape[1], d), np.float32)
        for t in steps:
            g = gates[t] + h @ p["u" + side]
            s, n = _sigmoid(g[:, : 3 * d]), np.tanh(g[:, 3 * d :])
            i, f, o = s[:, :d], s[:, d : 2 * d], s[:, 2 * d :]
            c1 = f * c + i * n
            tc = np.tanh(c1)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, n, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c1, c)
            out[t] = h
        return out

    def lstm_back(self, d_out: np.ndarray, x: np.ndarray, side: str, kept: list) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        p, d = self.p, HIDDEN_DIM
        d_g = np.zeros((len(x), x.shape[1], 4 * d), np.float32)
        d_u = np.zeros_like(p["u" + side])
        dh = np.zeros((x.shape[1], d), np.float32)
        dc = np.zeros_like(dh)
        for t, h, c, i, f, o, n, tc, m in reversed(kept):
            dh = dh + d_out[t]
            a, b = np.where(m, dh, 0), np.where(m, dc, 0)
            b = b + a * o * (1 - tc * tc)
            g = np.concatenate([b * n * i * (1 - i), b * c * f * (1 - f), a * tc * o * (1 - o), b * i * (1 - n * n)], 1)
            d_g[t] = g
            d_u += h.T @ g
            dh, dc = np.where(m, 0, dh) + g @ p["u" + side].T, np.where(m, b * f, dc)
        flat = d_g.reshape(-1, 4 * d)
        return d_g @ p["w" + side].T, {"w" + side: x.reshape(-1, x.shape[2]).T @ flat, "u" + side: d_u, "c" + side: flat.sum(0)}

    def label(self, pages: list[list[Block]], batch_blocks: int = 20_000) -> list[np.ndarray]:
        """The probability of each block that it is main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * len(pages[order[to]]) <= batch_blocks:
                to += 1
            rows = order[at:to]
            x, mask, place, _ = self.batch([page_features(pages[i]) for i in rows])
            logit = self.logits(x, mask)
            p = _sigmoid(logit)
            for k, i in enumerate(rows):
                out[i] = p[: len(pages[i]), k]
            at = to
        return out

    def batch(self, features: list[tuple]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], tuple]:
        size = [len(f[0]) for f in features]
        path, word = self.flat([t for f in features for t in f[0]]), self.flat([t for f in features for t in f[1]])
        rows = self.inputs(path, word, np.concatenate([f[2] for f in features]))
        step = np.concatenate([np.arange(n) for n in size])
        page = np.repeat(np.arange(len(size)), size)
        x = np.zeros((max(size), len(size), _INPUT), np.float32)
        mask = np.zeros((max(size), len(size)), bool)
        x[step, page], mask[step, page] = rows, True
        return x, mask, (step, page), (path, word)

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        kept: dict[str, list | None] = {s: [] if keep is not None else None for s in "fb"}
        h = {s: self.lstm(x, mask, s, kept[s]) for s in "fb"}
        if keep is not None:
            keep |= {"h": h, "kept": kept}
        return h["f"] @ self.p["out"][:HIDDEN_DIM] + h["b"] @ self.p["out"][HIDDEN_DIM:] + self.p["bias"]

    def train(self, features: list[tuple], labels: list[np.ndarray], state: dict, step: int, rate: float) -> float:
        """One step of Adam; the mean loss."""
        x, mask, (at, page), (path, word) = self.batch(features)
        keep: dict = {}
        logit = self.logits(x, mask, keep)
        y = np.zeros_like(logit)
        y[at, page] = np.concatenate(labels)
        q = _sigmoid(logit)
        d = np.where(mask, q - y, 0) / mask.sum()
        g = {"bias": np.array([d.sum()]), "out": np.concatenate([np.einsum("tb,tbh->h", d, keep["h"][s]) for s in "fb"])}
        d_x = np.zeros_like(x)
        for k, s in enumerate("fb"):
            dx, more = self.lstm_back(d[..., None] * self.p["out"][k * HIDDEN_DIM : (k + 1) * HIDDEN_DIM], x, s, keep["kept"][s])
            d_x += dx
            g |= more
        rows = d_x[at, page]
        for name, (tokens, _, count), lo, hi in (("path", path, 0, PATH_DIM), ("word", word, PATH_DIM, PATH_DIM + WORD_DIM)):
            g[name] = np.zeros_like(self.p[name])
            d_rows = rows[:, lo:hi] if name == "path" else rows[:, lo:hi] / np.sqrt(count)[:, None]
            np.add.at(g[name], tokens, np.repeat(d_rows, count, axis=0))
        for k, grad in g.items():
            m1, m2 = state.setdefault(k, (np.zeros_like(self.p[k]), np.zeros_like(self.p[k])))
            grad = grad + 1e-5 * self.p[k]
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            self.p[k] -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        p = np.clip(q, 1e-6, 1 - 1e-6)
        return float(-np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum())


class Generator:
    """Pages with known main text. Main blocks carry a mark that is taken out again."""

    MARK = ""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice(x) for x in ("bcdfghjklmnprstvwz", "aeiouéäöñ", "nrstl ".strip()))[: self.r.choice((2, 3))] for _ in range(60)]

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentences(self, lo: int, hi: int) -> str:
        return " ".join(self.words(1, 16).capitalize() + self.r.choice((".", ".", ".", "!", "?")) for _ in range(self.r.randint(lo, hi)))

    def some(self, chance: float, make: Callable[[], str]) -> str:
        return make() if self.r.random() < chance else ""

    def names(self, *options: str) -> str:
        """A class or an identifier out of the options; seldom one that says nothing."""
        r = self.r
        name = r.choice(options)
        if r.random() < 0.25:
            name = r.choice((f"{name}-{r.choice(('box', 'wrap', 'area', 'block', 'inner', '1'))}", f"site-{name}", f"main{name.capitalize()}"))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def item(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 3)}</a>'

    def menu(self) -> str:
        r = self.r
        items = [self.item() for _ in range(r.randint(2, 9))]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else r.choice((" | ", " ", " &raquo; ")).join(items)
        return f"<nav>{inner}</nav>" if r.random() < 0.5 else f"<div{self.names('nav', 'menu', 'navbar', 'breadcrumbs', 'navigation', 'links', 'topnav')}>{inner}</div>"

    def header(self) -> str:
        inner = self.some(0.7, lambda: f"<h1>{self.words(1, 4)}</h1>") + self.some(0.6, lambda: f"<p>{self.words(2, 8)}</p>") or self.words(1, 5)
        return f"<header>{inner}{self.some(0.3, self.menu)}</header>" if self.r.random() < 0.5 else f"<div{self.names('header', 'masthead', 'banner', 'topbar', 'branding', 'logo')}>{inner}</div>"

    def notice(self) -> str:
        text = self.r.choice(("We use cookies. ", "Cookies: ", "Please accept our privacy policy. ", "")) + self.sentences(1, 3)
        return f"<div{self.names('cookie', 'notice', 'consent', 'gdpr', 'alert', 'privacy', 'warning', 'popup')}>{self.r.choice((f'<p>{text}</p>', text))}{self.some(0.5, lambda: '<button>OK</button>')}</div>"

    def ad(self) -> str:
        r = self.r
        text = self.some(0.2, lambda: "Advertisement ") + r.choice((self.sentences(1, 4), self.words(2, 9)))
        inner = r.choice((text, f"<p>{text}</p>", f'<a href="http://{self.word()}.com">{text}</a>'))
        return self.some(0.3, lambda: f"<!-- ad {r.randint(1, 999)} -->") + f"<{(t := r.choice(('div', 'div', 'div', 'aside', 'ins', 'section')))}{self.names('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', 'adsense', 'sponsor')}>{inner}</{t}>"

    def sidebar(self) -> str:
        inner = "".join(
            f"<h3>{self.words(1, 3)}</h3>" + self.r.choice(("<ul>" + "".join(f"<li>{self.item()}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>", f"<p>{self.sentences(1, 3)}</p>"))
            for _ in range(self.r.randint(1, 3))
        )
        return f"<aside>{inner}</aside>" if self.r.random() < 0.4 else f"<div{self.names('sidebar', 'widget', 'related', 'aside', 'trending', 'popular', 'recommended', 'share', 'social')}>{inner}</div>"

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name=\"{self.word()}\">{self.some(0.5, lambda: f'<p>{self.sentences(1, 2)}</p>')}{self.some(0.4, lambda: f'<select><option>{self.word()}<option>{self.word()}</select>')}<button>{self.words(1, 2)}</button>"
        return f"<form{self.some(0.5, lambda: self.names('search', 'login', 'subscribe', 'newsletter', 'signup', 'contact'))}>{inner}</form>"

    def comments(self) -> str:
        r = self.r
        tag = r.choice(("div", "li", "article", "p"))
        one = lambda: f"<{tag}{self.names('comment', 'reply', 'response')}>{self.some(0.5, lambda: f'<b>{self.word()}</b> ')}{r.choice((self.sentences(1, 4), f'<div>{self.sentences(1, 4)}</div>'))}</{tag}>"
        head = self.some(0.6, lambda: f"<h3>{r.randint(1, 40)} {r.choice(('Comments', 'comments', self.word()))}</h3>")
        t = r.choice(("div", "section", "ol", "ul"))
        return f"<{t}{self.names('comments', 'discussion', 'responses', 'replies', 'disqus', 'respond')}>{head}{''.join(one() for _ in range(r.randint(1, 5)))}</{t}>"

    def footer(self) -> str:
        text = self.some(0.6, lambda: f"&copy; {self.r.choice(('', '2021 '))}{self.word()}.{self.word()}.com &middot; ") + self.r.choice((self.sentences(1, 3), self.words(2, 8)))
        inner = self.r.choice((text, f"<p>{text}</p>")) + self.some(0.4, lambda: "<ul>" + "".join(f"<li>{self.item()}</li>" for _ in range(3)) + "</ul>")
        return f"<footer>{inner}</footer>" if self.r.random() < 0.6 else f"<div{self.names('footer', 'copyright', 'legal', 'bottom', 'colophon')}>{inner}</div>"

    def article(self) -> str:
        r, k = self.r, self.MARK
        out = [f"<{(h := r.choice(('h1', 'h1', 'h2')))}>{k}{self.words(2, 12)}</{h}>"] if r.random() < 0.85 else []
        loose = r.random() < 0.15
        # Some articles are poor text, and main text all the same.
        odd = r.choice((lambda t: t.replace(" ", " | "), lambda t: t.upper().replace(" ", "!! "), lambda t: re.sub(" ", lambda _: r.choice(("*** ", "### ", "&amp;&amp;&amp; ", "$$$ ")), t), lambda t: " ".join(w for x in t.split(" ") for w in [x] * 5))) if r.random() < 0.2 else str
        if r.random() < 0.3:
            out.append(f"<p><b>{k}{self.sentences(1, 3)}<br>")
        for _ in range(r.randint(1, 3) if r.random() < 0.4 else r.randint(2, 14)):
            x = r.random()
            text = odd(self.sentences(1, 2) if r.random() < 0.3 else self.sentences(2, 9))
            if r.random() < 0.2:
                text = text.replace(" ", f" <a href='/{self.word()}'>{self.word()}</a> ", 1)
            if x < 0.8:
                out.append(f"<p>{k}{text}" + ("" if loose else "</p>"))
            elif x < 0.86:
                out.append("<ul>" + "".join(f"<li>{k}{self.r.choice((self.words(1, 6), self.sentences(1, 1)))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.9:
                out.append(f"<h3>{k}{self.words(1, 6)}</h3>")
            elif x < 0.93:
                out.append(f"<blockquote>{k}{text}</blockquote>")
            elif x < 0.95:
                out.append("<table><tr>" + "".join(f"<td>{k}{self.words(1, 3)}</td>" for _ in range(3)) + "</tr></table>")
            elif x < 0.97:
                out.append(f"<div>{k}{text}</div>")
            else:
                out.append(r.choice((self.ad, self.form, self.sidebar))())
        body = "".join(out) + self.some(0.08, self.comments)
        x = r.random()
        if x < 0.6:
            return f"<article{self.some(0.3, lambda: self.names('post', 'story', 'entry'))}>{body}</article>"
        tag = "main" if x < 0.7 else r.choice(("div", "section"))
        return f"<{tag}{self.names('content', 'article', 'post', 'entry', 'story', 'text', 'body', 'main')}>{body}</{tag}>"

    def page(self) -> str:
        s = self.some
        lead = [s(0.3, self.notice), s(0.4, self.header), s(0.8, self.menu), s(0.5, self.ad), s(0.15, self.form), s(0.2, self.sidebar)]
        tail = [s(0.4, self.sidebar), s(0.3, self.comments), s(0.25, self.ad), s(0.15, self.form), s(0.1, self.menu), s(0.1, self.notice)]
        self.r.shuffle(lead)
        self.r.shuffle(tail)
        inner = "".join(lead) + self.article() + "".join(tail) + s(0.85, self.footer)
        if self.r.random() < 0.3:
            inner = f"<div{self.names('wrapper', 'page', 'container', 'layout')}>{inner}</div>"
        page = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>var t=\"</p>\";</script></head><body>{inner}</body></html>"
        return page[: self.r.randint(len(page) // 2, len(page))] if self.r.random() < 0.1 else page

    def example(self) -> tuple[list[Block], np.ndarray]:
        blocks = page_blocks(self.page())
        y = np.array([self.MARK in b.text for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace(self.MARK, "") or "."
        return blocks, y


@lru_cache(maxsize=2)
def trained(pages: int = 1500, epochs: int = 6, seed: int = 3) -> Labeller:
    """A labeller fitted to so many generated pages; the same in every process."""
    g = Generator(seed)
    data = [x for x in (g.example() for _ in range(pages)) if x[0]]
    features = [page_features(b) for b, _ in data]
    model, state, step = Labeller(seed), {}, 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]) // 8)
        batches = [order[i : i + 32] for i in range(0, len(order), 32)]
        for k in rng.permutation(len(batches)):
            step += 1
            model.train([features[i] for i in batches[k]], [data[i][1] for i in batches[k]], state, step, 0.01 if epoch < epochs - 2 else 0.003)
    return model


def extract(model: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    blocks = [page_blocks(p or "") for p in pages]
    return ["\n\n".join(b.text for b, p in zip(bs, ps) if p >= 0.5) for bs, ps in zip(blocks, model.label(blocks))]


def _extracted(model: Labeller) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                text = extract(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, model: Labeller | None = None, source: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null or empty page, and one without main text, has the empty text; a very long one is labelled whole, all its
    blocks in one sequence. Repeated rows are read each; an empty table gives no rows; other columns are ignored, whatever their names. No shuffle.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    return rows.mapInArrow(_extracted(model or trained()), "page_id long, url string, text string, n_chars long")


def op2_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
