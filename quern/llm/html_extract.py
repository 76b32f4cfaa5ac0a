"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks in page order: the text between two block-level tags, with inline tags, comments, scripts,
styles, the head's title and text areas of forms taken out and character references decoded; formulas, drawings' texts, objects
and what stands for a missing script are read like any other element.  A block's input is the mean vector of its tag path (tags, words of class,
id and role of all open elements), of the nearest three of those, the mean vector of its hashed words, and a few numbers
(length, share of text in links, place in the page).  A bidirectional LSTM, in numpy, reads all blocks of a page both ways, so
that each is labelled in the light of the whole document; blocks labelled as main text are joined by line ends.

The network is trained on pages that training_page() makes from invented words in many layouts, and is the same on each run.

Cases: null, empty or text-less html gives an empty text; markup that isn't closed ends with the page; a quote opens a value
after an equals sign only; a block with a score of exactly 0.5 is main text; elements may be nested to any depth; white space is what
Unicode calls so, no-break spaces included; br is white space inside a block; repeated rows are extracted each; an empty table
gives an empty result; only the id, url and html columns are read, so other columns may have any names.  Nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Words, table

# --- blocks -----------------------------------------------------------------------------------------------------------

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))", re.I)
_RAW = frozenset("script style title textarea".split())  # scripts, styles, the head's title, and what stands in a form
_VOID = frozenset("br img hr meta link input source area base col embed track wbr param".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mlabeledtr mstyle mpadded mphantom mfenced menclose mmultiscripts mprescripts semantics annotation annotation-xml maction merror".split()
) | frozenset("svg g defs text tspan textpath".split())
#: What an opening tag closes, up to the nearest element in the second list.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table select body html td th article section div".split())


def _label(tag: str, rest: str) -> tuple[str, ...]:
    """Path words of an element."""
    out = [tag]
    for m in _ATTRIBUTE.finditer(rest):
        value = m[2] or m[3] or m[4] or ""
        out += [f".{x.lower()}" for x in re.findall(r"[A-Za-z][a-z]+|[A-Z]+", value)]
    return tuple(out)


@dataclass
class Block:
    path: tuple[tuple[str, ...], ...]
    text: str
    linked: int = 0


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(tuple(x[1] for x in stack if x[0] not in _INLINE), text, linked))
        parts, linked = [], 0

    def drop(k: int) -> None:
        nonlocal links
        links -= sum(x[0] == "a" for x in stack[k:])
        del stack[k:]

    at, links = 0, 0
    m = _MARKUP.search(page)
    while m:
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += links and len(page[at : m.start()].strip())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if tag:
            close, rest = m[1] or m[4], m[3] or m[6] or ""
            if tag not in _INLINE and tag not in _RAW:
                flush()
            elif tag == "br":
                parts.append(" ")
            if close:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        drop(k)
                        break
                    if tag in _INLINE and stack[k][0] not in _INLINE:
                        break  # an inline end tag doesn't close blocks
            elif tag in _RAW:  # a slash doesn't close these
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                m = _MARKUP.search(page, at)
                continue
            elif tag not in _VOID:
                if tag not in _INLINE:
                    closes = _CLOSES.get(tag, ("p",))
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in closes:
                            drop(k)
                            break
                        if stack[k][0] in _SCOPE:
                            break
                if not rest.rstrip().endswith("/"):
                    stack.append((tag, _label(tag, rest)))
                    links += tag == "a"
        m = _MARKUP.search(page, at)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


# --- inputs -----------------------------------------------------------------------------------------------------------

PATHS, WORDS, WIDE, NARROW, HIDDEN, NUMBERS = 2048, 1024, 20, 6, 24, 8
INPUT = 2 * WIDE + NARROW + NUMBERS


@lru_cache(maxsize=200_000)
def _path_ids(path: tuple[tuple[str, ...], ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    def ids(words: Iterator[str]) -> tuple[int, ...]:
        return tuple(zlib.crc32(w.encode()) % PATHS for w in words) or (0,)

    inner = path[-3:]
    return ids(w for x in path for w in x), ids(f"{w}^{len(inner) - k}" for k, x in enumerate(inner) for w in x)


def _numbers(page: list[Block]) -> np.ndarray:
    n = len(page)
    x = np.zeros((n, NUMBERS), np.float32)
    for i, b in enumerate(page):
        size = len(b.text)
        x[i] = (np.log1p(size) / 6, min(1, b.linked / size), i / n, 1 - i / n, min(1, n / 40), b.text.count(" ") == 0, b.text[-1] in ".!?…:", len(b.path) / 8)
    return x


@dataclass
class Batch:
    """Blocks of some pages: hashed paths and words as flat ids with their block, numbers, and the place of each block."""

    paths: list[np.ndarray] = field(default_factory=list)
    numbers: np.ndarray | None = None
    lengths: np.ndarray | None = None


def _flat(lists: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists])
    return np.fromiter((y for x in lists for y in x), np.int64, int(n.sum())), np.repeat(np.arange(len(lists)), n)


def batch_of(pages: list[list[Block]]) -> Batch:
    every = [b for p in pages for b in p]
    ids = [_path_ids(b.path) for b in every]
    data = "".join(b.text for b in every).encode()
    off = np.concatenate([[0], np.cumsum([len(b.text.encode()) for b in every])]).astype(np.int64)
    w = Words(np.frombuffer(data, np.uint8), off)
    word_ids, word_block = (w.hash % np.uint64(WORDS)).astype(np.int64), w.doc
    return Batch([*_flat([x[0] for x in ids]), *_flat([x[1] for x in ids]), word_ids, word_block], np.concatenate([_numbers(p) for p in pages if p]) if every else np.zeros((0, NUMBERS), np.float32), np.array([len(p) for p in pages]))


def _means(table_: np.ndarray, ids: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Mean vector of each block's ids, which stand in the order of blocks; none of them: zeros."""
    count = np.bincount(block, minlength=n)
    out = np.zeros((n, table_.shape[1]), table_.dtype)
    has = np.flatnonzero(count)
    if len(has):
        out[has] = np.add.reduceat(table_[ids], (np.cumsum(count) - count)[has], axis=0) / count[has, None]
    return out


def _scattered(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of each id."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    if len(first):
        out[ids[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.w = {"path": r.normal(0, 0.3, (PATHS, WIDE)), "inner": r.normal(0, 0.3, (PATHS, WIDE)), "word": r.normal(0, 0.1, (WORDS, NARROW)), "out": r.normal(0, 0.2, (2 * HIDDEN + INPUT, 1)), "bias": np.zeros(1)}
        for way in ("f", "b"):
            self.w[f"x{way}"] = r.normal(0, 0.2, (INPUT, 4 * HIDDEN))
            self.w[f"h{way}"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            self.w[f"c{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.w = {n: x.astype(np.float32) for n, x in self.w.items()}

    def inputs(self, b: Batch) -> np.ndarray:
        n = len(b.numbers)
        return np.concatenate([_means(self.w["path"], b.paths[0], b.paths[1], n), _means(self.w["inner"], b.paths[2], b.paths[3], n), _means(self.w["word"], b.paths[4], b.paths[5], n), b.numbers], 1)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """x (length, pages, INPUT) -> hidden states in the same order; reversed for way b.  Padding keeps the state."""
        steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((x.shape[1], HIDDEN), x.dtype)
        c = h.copy()
        given, out, kept = x @ self.w[f"x{way}"] + self.w[f"c{way}"], np.zeros((*x.shape[:2], HIDDEN), x.dtype), []
        for t in steps:
            g = given[t] + h @ self.w[f"h{way}"]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            on = mask[t][:, None]
            c_new = np.where(on, f * c + i * u, c)
            tanh = np.tanh(c_new)
            h_new = np.where(on, o * tanh, h)
            kept.append((t, i, f, o, u, c, h, tanh, on))
            c, h = c_new, h_new
            out[t] = h
        return out, kept

    def _place(self, b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        page = np.repeat(np.arange(len(b.lengths)), b.lengths)
        at = np.arange(len(page)) - np.repeat(np.cumsum(b.lengths) - b.lengths, b.lengths)
        mask = np.zeros((max(1, int(b.lengths.max(initial=0))), len(b.lengths)), bool)
        mask[at, page] = True
        return at, page, mask

    def forward(self, b: Batch) -> tuple[np.ndarray, tuple]:
        flat = self.inputs(b)
        at, page, mask = self._place(b)
        x = np.zeros((*mask.shape, INPUT), flat.dtype)
        x[at, page] = flat
        hf, kf = self._run(x, mask, "f")
        hb, kb = self._run(x, mask, "b")
        joined = np.concatenate([hf[at, page], hb[at, page], flat], 1)
        return _sigmoid(joined @ self.w["out"] + self.w["bias"])[:, 0], (flat, x, at, page, mask, kf, kb, joined)

    def _back(self, x: np.ndarray, dh_out: np.ndarray, kept: list, way: str, grads: dict) -> np.ndarray:
        dx = np.zeros_like(x)
        dh, dc = np.zeros((x.shape[1], HIDDEN), x.dtype), np.zeros((x.shape[1], HIDDEN), x.dtype)
        wx, wh = np.zeros_like(self.w[f"x{way}"]), np.zeros_like(self.w[f"h{way}"])
        bias = np.zeros(4 * HIDDEN, x.dtype)
        for t, i, f, o, u, c, h, tanh, on in reversed(kept):
            dh = dh + dh_out[t]
            d = np.where(on, dh, 0)
            dct = np.where(on, dc + d * o * (1 - tanh**2), 0)
            g = np.concatenate([dct * u * i * (1 - i), dct * c * f * (1 - f), d * tanh * o * (1 - o), dct * i * (1 - u**2)], 1)
            wx += x[t].T @ g
            wh += h.T @ g
            bias += g.sum(0)
            dx[t] = g @ self.w[f"x{way}"].T
            dh = np.where(on, g @ self.w[f"h{way}"].T, dh)
            dc = np.where(on, dct * f, dc)
        grads[f"x{way}"], grads[f"h{way}"], grads[f"c{way}"] = wx, wh, bias
        return dx

    def gradients(self, b: Batch, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (flat, x, at, page, mask, kf, kb, joined) = self.forward(b)
        d = ((p - y) / len(y))[:, None].astype(joined.dtype)
        grads = {"out": joined.T @ d, "bias": d.sum(0)}
        dj = d @ self.w["out"].T
        dx = np.zeros_like(flat)
        for k, (way, kept) in enumerate((("f", kf), ("b", kb))):
            dh = np.zeros((*mask.shape, HIDDEN), x.dtype)
            dh[at, page] = dj[:, k * HIDDEN : (k + 1) * HIDDEN]
            dx += self._back(x, dh, kept, way, grads)[at, page]
        dx += dj[:, 2 * HIDDEN :]
        lo = 0
        for k, name in enumerate(("path", "inner", "word")):
            ids, block = b.paths[2 * k], b.paths[2 * k + 1]
            wide = self.w[name].shape[1]
            per = dx[:, lo : lo + wide] / np.maximum(np.bincount(block, minlength=len(flat)), 1)[:, None]
            grads[name] = _scattered(ids, per[block], len(self.w[name]))
            lo += wide
        return grads

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray], epochs: int = 14, size: int = 32, rate: float = 0.01, seed: int = 2) -> Labeller:
        r = np.random.default_rng(seed)
        order = np.argsort([len(p) for p in pages], kind="stable")
        groups = [order[i : i + size] for i in range(0, len(order), size)]
        made = [(batch_of([pages[i] for i in g]), np.concatenate([labels[i] for i in g])) for g in groups]
        first, second = ({n: np.zeros_like(x) for n, x in self.w.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            for k in r.permutation(len(made)):
                step += 1
                for n, g in self.gradients(*made[k]).items():
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.99 * second[n] + 0.01 * g * g
                    self.w[n] -= rate * (1 - 0.9 * epoch / epochs) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
        return self


# --- training pages ---------------------------------------------------------------------------------------------------

#: Class words of what isn't main text, and of what is.
ASIDE = "ad ads advert advertisement banner sponsor sponsored promo promotion sidebar side-bar widget menu nav navbar navigation topnav breadcrumb breadcrumbs cookie cookie-notice cookie-banner consent gdpr notice alert announcement notification popup modal overlay newsletter subscribe signup related related-posts recommended more-stories share social sharing toolbar tags pagination pager header site-header masthead top-bar footer site-footer bottom copyright legal disclaimer login search search-form form contact-form comments comment comment-list reader-comments discussion replies responses".split()
MAIN = "content article article-body post post-content entry entry-content story story-body main main-content body text page-content markdown-body blog-post news-article content-body".split()
NEUTRAL = "wrapper container row col inner layout page site wrap grid box section clearfix outer block".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice("th er on an re he in ed ou ver sch ción que aux ment do the of and it le la de die und é ñ ß os as en".split()) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))


def _prose(r: random.Random, lo: int, hi: int) -> str:
    n = r.randint(lo, hi)
    style = r.random()
    words = [_word(r) for _ in range(n)]
    if style < 0.1:
        words = [w.upper() + "!!" for w in words]
    elif style < 0.2:
        words = [w + r.choice(("***", "###", "%%%", "$$$", "&amp;&amp;")) for w in words]
    elif style < 0.25:
        words = [words[0]] * n
    elif style < 0.3:
        words = " | ".join(words).split(" ")
    elif r.random() < 0.8:
        words = [w + ("." if r.random() < 0.1 else "," if r.random() < 0.1 else "") for w in words]
        words[-1] += "."
    words[0] = words[0][:1].upper() + words[0][1:]
    return " ".join(words)


def training_page(r: random.Random) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks in order, whether it is main text."""
    out, labels = [], []
    if r.random() < 0.02:
        return r.choice(("", "<html><body>", "<div>")) + _prose(r, 1, 60), [True]

    def put(tag: str, text: str, main: bool, attrs: str = "", close: bool = True) -> None:
        out.append(f"<{tag}{attrs}>{text}" + (f"</{tag}>" if close else ""))
        labels.append(main)

    def attr(words: list[str], chance: float = 0.9) -> str:
        if r.random() > chance:
            return ""
        w = r.choice(words)
        if r.random() < 0.3:
            w += "-" + r.choice(("1", "box", "area", "wrap", "top", "left", "right", "block", "list", "item"))
        if r.random() < 0.2:
            w += " " + r.choice(NEUTRAL)
        return f' {r.choice(("class", "class", "id"))}="{w}"'

    def link(n: int = 1) -> str:
        return " ".join(f'<a href="/{_word(r)}">{_prose(r, 1, 3)}</a>' for _ in range(n))

    def links(lo: int, hi: int) -> None:
        out.append("<ul>")
        for _ in range(r.randint(lo, hi)):
            put("li", link(), False)
        out.append("</ul>")

    def noise(kind: str) -> None:
        """A part that isn't main text."""
        if kind == "nav":
            div = r.random() < 0.3
            out.append(r.choice(('<div class="menu">', '<div role="navigation">')) if div else r.choice(("<nav>", f"<nav{attr(ASIDE)}>")))
            links(2, 8)
            out.append("</div>" if div else "</nav>")
        elif kind in ("header", "footer"):
            tag = r.choice((kind, "div"))
            out.append(f"<{tag}" + (attr([kind, f"site-{kind}", f"page-{kind}"], 1 if tag == "div" else 0.4)) + ">")
            for _ in range(r.randint(1, 3)):
                put(r.choice(("p", "div", "div")), ("&copy; " if kind == "footer" and r.random() < 0.6 else "") + r.choice((_prose(r, 2, 14), link(3), f"{_word(r)}.example.com &middot; {_prose(r, 3, 9)}")), False)
            if kind == "header" and r.random() < 0.4:
                put("h1" if r.random() < 0.3 else "div", _prose(r, 1, 4), False)
            out.append(f"</{tag}>")
        elif kind == "form":
            out.append(f"<form{attr(ASIDE, 0.5)}>")
            put("p", _prose(r, 1, 8), False)
            put("button", _prose(r, 1, 2), False)
            out.append("</form>")
        elif kind == "comments":
            tag = r.choice(("section", "div", "ul", "aside"))
            out.append(f'<{tag} {r.choice(("class", "id"))}="{r.choice(("comments", "comment-list", "reader-comments", "discussion", "replies", "responses", "comment-section"))}">')
            if r.random() < 0.7:
                put(r.choice(("h2", "h3", "h4")), r.choice(("Comments", _prose(r, 1, 3))), False)
            for _ in range(r.randint(1, 5)):
                inner = "li" if tag == "ul" else r.choice(("div", "article", "p"))
                if inner == "p" or r.random() < 0.4:
                    put(inner, _prose(r, 3, 60), False, r.choice(("", ' class="comment"')))
                else:
                    out.append(f'<{inner} class="comment">')
                    put("p", _prose(r, 3, 60), False)
                    out.append(f"</{inner}>")
            out.append(f"</{tag}>")
        else:
            tag = r.choice(("div", "div", "aside", "section", "p"))
            plain = tag == "aside" and r.random() < 0.5
            if tag == "p" or r.random() < 0.5:
                put(tag, _prose(r, 3, 40), False, "" if plain else attr(ASIDE, 1))
            else:
                out.append(f"<{tag}{'' if plain else attr(ASIDE, 1)}>")
                if r.random() < 0.4:
                    put(r.choice(("h2", "h3", "h4")), _prose(r, 1, 4), False)
                if r.random() < 0.4:
                    links(1, 5)
                for _ in range(r.randint(1, 3)):
                    put("p", _prose(r, 2, 40), False)
                out.append(f"</{tag}>")

    out.append(f'<!DOCTYPE html><html lang="en"><head><title>{_prose(r, 2, 6)}</title><style>p{{}}</style></head><body>')
    outer = r.choice(("", "", f'<div class="{r.choice(NEUTRAL)}">'))
    out.append(outer)
    for kind in ("header", "nav", "notice", "ad", "aside", "form"):
        if r.random() < (0.6 if kind == "nav" else 0.3):
            noise(kind)
    holder = r.choice(("article", "article", "article", "main", "div", "div", "section", "both", "bare"))
    opened, closed = {
        "article": (f"<article{attr(MAIN, 0.3)}>", "</article>"), "main": (f"<main{attr(MAIN, 0.3)}>", "</main>"), "div": (f"<div{attr(MAIN, 1)}>", "</div>"), "section": (f"<section{attr(MAIN, 1)}>", "</section>"),
        "both": (f"<main><article{attr(MAIN, 0.5)}>", "</article></main>"), "bare": ("", ""),
    }[holder]
    out.append(opened)
    if r.random() < 0.8:
        wrapped = holder in ("article", "both") and r.random() < 0.2
        out.append("<header>" if wrapped else "")
        put("h1", _prose(r, 2, 9), True)
        out.append("</header>" if wrapped else "")
    for k in range(r.choice((0, 1, 1, 2, 3, 4, 6, 9, 14))):
        kind = r.random()
        if kind < 0.04:
            out.append(_prose(r, 3, 40))  # text without a tag of its own
            labels.append(True)
            out.append("<div></div>")
        elif kind < 0.62:
            put("p", _prose(r, 1, 90) if r.random() < 0.85 else _prose(r, 1, 4), True, close=r.random() < 0.85)
        elif kind < 0.68:
            out.append(f"<p><b>{_prose(r, 4, 60)}<br>")
            labels.append(True)
        elif kind < 0.74:
            put(r.choice(("h2", "h3", "h4")), _prose(r, 1, 7), True)
        elif kind < 0.8:
            tag = r.choice(("ul", "ol"))
            out.append(f"<{tag}>")
            for _ in range(r.randint(1, 5)):
                put("li", r.choice((_prose(r, 1, 20), link() + " " + _prose(r, 1, 12))), True)
            out.append(f"</{tag}>")
        elif kind < 0.83:
            put(r.choice(("blockquote", "pre", "figcaption")), _prose(r, 2, 40), True)
        elif kind < 0.86:
            out.append("<table>")
            for _ in range(r.randint(1, 3)):
                out.append("<tr>")
                for _ in range(2):
                    put("td", _prose(r, 1, 4), True)
                out.append("</tr>")
            out.append("</table>")
        elif kind < 0.9:
            out.append(f'<div{r.choice(("", " class=%s" % r.choice(NEUTRAL)))}>')
            put("p", _prose(r, 3, 60), True)
            out.append("</div>")
        else:
            noise(r.choice(("ad", "aside", "share", "form", "notice")))
    if r.random() < 0.15:
        noise("comments")
    out.append(closed)
    for kind in ("comments", "aside", "ad", "nav", "form", "footer", "notice"):
        if r.random() < (0.7 if kind == "footer" else 0.25):
            noise(kind)
    out.append("</div>" if outer else "")
    out.append("</body></html>" if r.random() < 0.8 else "")
    return "".join(out), labels


@lru_cache(maxsize=1)
def labeller(pages: int = 2000, epochs: int = 10, seed: int = 4) -> Labeller:
    r = random.Random(seed)
    read, labels = [], []
    while len(read) < pages:
        page, marks = training_page(r)
        found = blocks(page)
        if found and len(found) == len(marks):
            read.append(found)
            labels.append(np.array(marks, float))
    return Labeller().fit(read, labels, epochs)


# --- the operator -----------------------------------------------------------------------------------------------------


def main_texts(pages: list[str], model: Labeller, most: int = 2000) -> list[str]:
    """The main text of each page; so many blocks at a time, pages of like length together."""
    found = [blocks(p) for p in pages]
    order = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    out = [""] * len(pages)
    at = 0
    while at < len(order):
        part = [order[at]]
        while at + len(part) < len(order) and (len(part) + 1) * len(found[order[at + len(part)]]) <= most:
            part.append(order[at + len(part)])
        at += len(part)
        p, _ = model.forward(batch_of([found[i] for i in part]))
        k = 0
        for i in part:
            out[i] = "\n".join(b.text for b, x in zip(found[i], p[k : k + len(found[i])], strict=True) if x >= 0.5)
            k += len(found[i])
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller())
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts = main_texts([x or "" for x in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, _url string, text string, n_chars long").select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
