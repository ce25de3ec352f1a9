"""Main text of web pages as the maximum-scoring subsequence of words and tags.

Words score positive and tags negative. The weights come from labelled pages (``html_pages``): a word scores by how
likely its open elements (names and class words) enclose main text, a tag by how much more it occurs outside of it.
A linear scan finds the contiguous region of the highest total, and the blocks in it whose words score positive are
the text; so adverts inside an article are passed over, and menus, notes or comments after it are left outside.

Character references are decoded, white space in a block becomes one space, blocks are joined by two line feeds.
Null or empty html, or a page without words in any main context, gives the empty text; an empty table an empty result.
Broken markup never fails: an unclosed tag ends at the next ``>`` or at the end, an unclosed comment hides the rest, end
tags without a start are ignored. What stands in svg is no text; one that ends in ``/>`` or has no end tag hides
nothing. Time is linear in the page. Of regions with equal totals the one that ends first counts, and of those the
longest. Equal rows get equal texts; other columns, whatever their names, are ignored, and a null page_id or url stays
null.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .html_pages import PAGES

BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol option p pre section select summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template svg iframe".split())
FOREIGN = frozenset("svg math".split())
TEXTLESS = frozenset("title textarea".split())
HIDDEN = frozenset("head noscript button select option label".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
UNLIKELY = -0.85
_MARKUP = re.compile(r"<(?=[a-zA-Z!?/])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


def events(page: str):
    """("open", name, features), ("close", name) and ("text", decoded text) in page order."""
    at, n = 0, len(page)
    ends: dict[str, int] = {}  # where the next end tag of a name stands, looked up once for all starts before it

    def end_tag(name: str) -> int:
        if ends.get(name, -1) < at:
            m = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            ends[name] = m.start() if m else n
        return ends[name]

    while at < n:
        m = _MARKUP.search(page, at)
        lt = m.start() if m else n
        if lt > at:
            yield "text", html.unescape(page[at:lt])
        if lt == n:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        name, rest = m[1].lower(), _REST.match(page, m.end())
        end = rest.end() if rest else (page.find(">", m.end()) + 1 or n)
        at = end
        if page[lt + 1] == "/":
            yield "close", name
            continue
        attrs = page[m.end() : end]
        words = {w for a in _ATTR.finditer(attrs) for w in _WORDS.findall((a[2] or a[3] or a[4] or "").lower())} if "=" in attrs else set()
        yield "open", name, (name, *sorted("." + w for w in words))
        if name in FOREIGN and page.endswith("/>", m.end(), end):
            yield "close", name
            continue
        if name in RAW or name in TEXTLESS:
            stop = end_tag(name)
            if name in FOREIGN and stop == n:
                yield "close", name
                continue
            if name not in RAW and stop < n:
                yield "text", html.unescape(page[end:stop])
            at = stop


def walk(page: str, weight, bias: float, tell: bool = False):
    """Items in page order: ("tag", name, block break?, sum of open weights) and ("text", text, sum of open weights, hidden?, features).

    Only sums are carried along the open elements, and their number by name, so an element costs the same however deep
    it stands and an end tag without a start costs nothing. ``tell`` adds the features of the open elements to texts.
    """
    stack: list[tuple[str, float, bool, tuple]] = []
    opened: Counter = Counter()

    def drop() -> None:
        opened[stack.pop()[0]] -= 1

    for event in events(page):
        total, hidden = (stack[-1][1], stack[-1][2]) if stack else (bias, False)
        if event[0] == "text":
            yield "text", event[1], total, hidden, [f for x in stack for f in x[3]] if tell else ()
            continue
        name = event[1]
        if event[0] == "close":
            yield "tag", name, name in BLOCKS, total
            if opened[name]:
                while stack[-1][0] != name:
                    drop()
                drop()
            continue
        while stack and name in CLOSES and stack[-1][0] in CLOSES[name]:
            drop()
        if name in BLOCKS and name != "p":
            while stack and stack[-1][0] == "p":
                drop()
        total, hidden = (stack[-1][1], stack[-1][2]) if stack else (bias, False)
        own = total + sum(weight(f) for f in event[2])
        yield "tag", name, name in BLOCKS, own
        if name not in VOID:
            stack.append((name, own, hidden or name in HIDDEN or name in RAW or name in TEXTLESS, event[2]))
            opened[name] += 1


@functools.cache
def model() -> tuple[dict[str, float], float, dict[str, float]]:
    """Weights of element names and class words, the bias, and the scores of tags, learned from the labelled pages."""
    rows, inside, outside = [], Counter(), Counter()
    for page in PAGES:
        depth = 0
        for item in walk(page, lambda f: 0.0, 0.0, tell=True):
            if item[0] == "tag":
                (inside if depth > 0 else outside)[item[1]] += 1
                continue
            for piece in re.split(r"(\{\{|\}\}|\[\[|\]\])", item[1]):
                if piece in ("{{", "]]"):
                    depth += 1
                elif piece in ("}}", "[["):
                    depth -= 1
                elif piece.split() and not item[3]:
                    rows.append((Counter(item[4]), len(piece.split()), depth > 0))
    names = {f: i for i, f in enumerate(sorted({f for r, _, _ in rows for f in r}))}
    x = np.zeros((len(rows), len(names) + 1))
    for i, (feats, _, _) in enumerate(rows):
        for f, c in feats.items():
            x[i, names[f]] = min(c, 2)
        x[i, -1] = 1
    y, n = np.array([m for _, _, m in rows], dtype=float), np.sqrt([float(n) for _, n, _ in rows])
    w = np.zeros(x.shape[1])
    for _ in range(4000):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.05 * (x.T @ (n * (p - y)) / n.sum() * 10 + 0.0015 * np.append(w[:-1], 0))
    tags = {t: -min(0.8, max(0.05, 0.35 * np.log((outside[t] + 1) / (inside[t] + 1)) + 0.15)) for t in inside | outside}
    return {f: float(w[i]) for f, i in names.items()}, float(w[-1]), {t: float(v) for t, v in tags.items()}


def best_segment(scores: list[float]) -> tuple[int, int]:
    """The stretch of the highest positive total in one scan; of equal totals the one that ends first, and of those
    the longest; (0, 0) if no total is positive."""
    best, total, first, region = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total < 0:
            total, first = 0.0, i
        total += s
        if total > best:
            best, region = total, (first, i + 1)
    return region


def extract(page: str | None) -> str:
    """The main text of one page; where no context is likely, contexts that are merely open to it count."""
    if not page:
        return ""
    weights, bias, _ = model()
    items = list(walk(page, lambda f: weights.get(f, 0.0), bias))
    return next((t for level in (0.4, 0.25, 0.1) if (t := _extract(items, level))), "")


def _extract(items: list[tuple], level: float) -> str:
    tags = model()[2]
    blocks: list[tuple[int, int, str]] = []  # place of the block's first and last item, text
    scores: list[float] = []
    held: list[str] = []
    since = 0

    def close() -> None:
        text = " ".join("".join(held).split())
        if text:
            blocks.append((since, len(scores), text))
        held.clear()

    for item in items:
        if item[0] == "tag":
            if item[2]:
                close()
                since = len(scores)
            elif item[1] in ("br", "td", "th"):
                held.append(" ")
            share = 0.05 if item[3] < UNLIKELY else 0.25 if item[3] > 0 else 1.0  # little inside what is known either way
            scores.append(share * tags.get(item[1], -0.2))
            continue
        _, text, total, hidden, _ = item
        score = 1 / (1 + np.exp(-max(-30.0, min(30.0, total)))) - level
        n = len(text.split())
        if hidden or score <= 0:
            scores.append(-0.01 * min(n, 20))
            if n:
                held.append(" ")
            continue
        held.append(text)
        scores.append(score * n)
    close()
    first, last = best_segment(scores)
    return "\n\n".join(t for s, e, t in blocks if s < last and e > first)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    def one(batch: pa.RecordBatch) -> dict:
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": [extract(h) for h in batch.column("html").to_pylist()]}

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), one, "page_id long, url string, text string")


def digest(found: DataFrame) -> DataFrame:
    """The result with its length in code points."""
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
