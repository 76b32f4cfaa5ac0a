"""Saved pages to typed blocks, one to many, in Arrow batches.

Two passes: the elements of KINDS and the posts of accessible pages, then every text between tags that is long and relevant,
since saved posts often stand in spans and divs only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.evidence import TRAFFIC

#: Elements without text of their own, and block elements with the kind of their text.
DROPPED = frozenset(("script", "style", "svg", "noscript", "template"))
KINDS = {"h1": "headline", "h2": "headline", "h3": "headline", "p": "article", "li": "article", "blockquote": "article", "figcaption": "caption", "time": "published_time", "article": "article", "td": "article"}
NOISE = re.compile(r"(?i)^(share|like|comment|reply|follow|subscribe|log in|sign up|see more|advertisement)\b")
RELEVANT = re.compile(TRAFFIC)
#: Characters of a text outside the elements above; blocks that are posts at most, on pages of that platform.
LEAST_LEAF, POSTS, POST_PLATFORM = 45, 11, "Facebook"
DATE = re.compile(r"\b\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) 20\d\d\b")


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, int]] = []
        self.counts: list[dict[str, int]] = [{}]
        self.attrs: list[tuple[str, bool]] = []
        self.open: list[list] = []
        self.dropped = 0
        self.found: list[tuple[str, str, str]] = []
        self.leaves: list[tuple[str, str, str]] = []
        self.title = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            if self.open:
                self.open[-1][2].append(" ")
            return
        if tag in ("p", "li", "td") and any(t == tag for t, _ in self.path[-2:]):
            self.handle_endtag(tag)
        if tag in ("div", "p") and self.open and self.open[-1][5] and self.open[-1][3] == len(self.path):
            self.open[-1][6] = True
        has = {k: (v or "").lower() for k, v in attrs}
        post = tag == "div" and has.get("dir") == "auto" and any(x for _, x in self.attrs)
        n = self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        self.path.append((tag, n))
        self.counts.append({})
        self.attrs.append((has.get("aria-label", ""), has.get("role") == "article"))
        self.dropped += tag in DROPPED
        if tag in KINDS or post:
            self.open.append([KINDS.get(tag, "article"), self._selector(), [], len(self.path), has.get("aria-label", ""), post, False])

    def handle_endtag(self, tag: str) -> None:
        if all(t != tag for t, _ in self.path):
            return
        while self.path:
            while self.open and self.open[-1][3] >= len(self.path):
                self._close()
            t, _ = self.path.pop()
            self.counts.pop()
            self.attrs.pop()
            self.dropped -= t in DROPPED
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        if self.open:
            self.open[-1][2].append(data)
        tag = self.path[-1][0] if self.path else ""
        self.title += data if tag == "title" else ""
        text = _clean(data)
        if text and len(text) >= LEAST_LEAF:
            self.leaves.append((_kind(KINDS.get(tag, "article"), self.attrs[-1][0] if self.attrs else "", text), self._selector(), text))

    def _selector(self) -> str:
        return " > ".join(f"{t}:nth-of-type({k})" for t, k in self.path[-5:])

    def _close(self) -> None:
        kind, selector, parts, _, label, _, holds = self.open.pop()
        if holds:  # a div around other blocks is none itself
            if self.open:
                self.open[-1][2] += parts
            return
        if text := _clean("".join(parts)):
            self.found.append((_kind(kind, label, text), selector, text))

    def finish(self, keywords: Iterable[str] = (), declared: bool = False, posts: bool = False) -> list[tuple[str, str, str]]:
        self.close()
        while self.open:
            self._close()
        keywords = [k.casefold() for k in keywords]
        leaves = [b for b in self.leaves if declared or RELEVANT.search(b[2]) or any(k in b[2].casefold() for k in keywords)]
        seen: set[str] = set()
        out = [b for b in (*self.found, *leaves) if not (b[2] in seen or seen.add(b[2]))]
        posts = posts or POST_PLATFORM.casefold() in self.title.casefold()
        return [("post" if posts and b[0] == "article" and k < POSTS else b[0], *b[1:]) for k, b in enumerate(out)]


def _clean(text: str) -> str | None:
    """The text in single spaces, if it is not noise."""
    text = " ".join(text.split())
    letters = text.split()
    return None if len(text) < 2 or NOISE.match(text) or sum(len(x) == 1 for x in letters) > 0.55 * len(letters) else text


def _kind(kind: str, label: str, text: str) -> str:
    if kind == "article" and DATE.search(text):
        return "published_time"
    return "comment" if kind == "article" and "comment" in label else kind


def read_blocks(html: str | None, keywords: Iterable[str] = (), declared: bool = False) -> list[tuple[str, str, str]]:
    """(kind, selector, text) of each block of a page, texts once each; keywords of its source and whether that is declared an
    incident decide, with the lexicon, which texts outside the known elements are read."""
    reader = _Blocks()
    reader.feed(html or "")
    return reader.finish(keywords, declared, POST_PLATFORM in (html or "")[:5000])


def page_blocks(pages: DataFrame, id_col: str, html_col: str, keywords: Column | None = None, declared: Column | None = None) -> DataFrame:
    """id, ord, kind, locator, text, block_id for each block of each page."""
    none = F.array().cast("array<string>")
    keywords, declared = none if keywords is None else F.coalesce(keywords, none), F.lit(False) if declared is None else F.coalesce(declared, F.lit(False))
    own = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"), keywords.alias("_keywords"), declared.alias("_declared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for i, page in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                for k, (kind, selector, text) in enumerate(read_blocks(*page)):
                    rows.append(i)
                    for to, v in zip(out, (k, kind, selector, text), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.string()) for x in out[1:])], ["_id", "ord", "kind", "locator", "text"])

    kind = own.schema["_id"].dataType.simpleString()
    blocks = own.mapInArrow(run, f"_id {kind}, ord int, kind string, locator string, text string")
    key = F.concat(F.lit("blk_"), F.substring(F.sha2(F.concat_ws("|", F.col("_id").cast("string"), F.col("ord").cast("string"), "text"), 256), 1, 16))
    return blocks.withColumn("block_id", key).withColumnRenamed("_id", id_col)
