"""Main text of web pages: the maximum-scoring run of words and tags, with scores learned from labelled pages.

A page is read as a row of words and tags. What stands above a word (elements, words in their classes, ids and roles, links,
headings, whether the page has an article elsewhere) gives the log odds that it is main text, by a logistic model that is
learned from labelled pages. Where they are positive they are the word's score; elsewhere the word is no main text and
scores 0. Tags score negative, by how seldom tags of their sort lie within the main text of labelled pages; those around
and within what is no main text score 0, so that no amount of it parts a text. A linear scan finds the contiguous run with
the largest sum; its words that are main text are put together by block.

The labelled pages (`pages_by_build.py`) are drawn at random from many builds, with a fixed seed; `learn` takes any others.

Null and empty pages, and pages without a word of main text, give the empty text. Broken markup is read on: a tag that
never ends is text, quotes that don't close are no quotes from there on, an element that never closes ends with its parent,
scripts and comments that never close end with the page. Reading takes time in proportion to the page, whatever it holds.
Text is kept whole, however long. Equal pages give equal texts, ids aren't looked at. An empty table gives no rows. A column
of the input that has the name of a new one is kept with underscores before its name.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import appended, table
from .pages_by_build import MAIN, labelled_pages

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s\"'/]|$)", re.I)
#: Words of a name: runs of letters, cut before a capital that follows a small letter.
PARTS = re.compile(r"[a-z]+|[A-Z]+[a-z]*")
SPACES = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is read up to their end tag, whatever it holds.
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold blocks rather than text; paragraphs and the like are a kind of their own.
FRAMES = frozenset("body center dd div dl dt main section table tbody td th thead tr article".split())
#: Elements that hold something else than text, or what stands in for it; without an end tag behind them they hold nothing.
EMBEDDED = frozenset("object canvas iframe svg math video audio noscript template select dialog".split())
#: Elements that hold text: names on them say less than on others.
TEXTS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre figcaption caption td th dt dd".split())
#: Elements that an unclosed paragraph or list item ends at, through at most so many inline elements.
ENDS_P, THROUGH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), 64
#: The largest score of a word, the penalty on weights, and rounds of fitting.
CAP, RIDGE, ROUNDS = 4.0, 0.05, 14


def tokens(page: str) -> Iterable[tuple[int, str, str, str]]:
    """(place, kind, name or text, rest) of each piece in turn; kind: text, start, end."""
    low = None
    at, n, quotes = 0, len(page), True
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            yield at, "text", page[at:], ""
            return
        if begin > at:
            yield at, "text", page[at:begin], ""
        name = NAME.match(page, begin + 1)
        if name is None:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin)
                at = n if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), begin):
                end = page.find(">", begin)
                at = n if end < 0 else end + 1
            else:
                yield begin, "text", "<", ""
                at = begin + 1
            continue
        end = _tag_end(page, name.end()) if quotes else page.find(">", name.end())
        if end < 0 and quotes:
            quotes = False
            end = page.find(">", name.end())
        if end < 0:
            # no tag ends from here on
            yield begin, "text", page[begin:], ""
            return
        rest = page[name.end() : end]
        at = end + 1
        if name[0][0] == "/":
            yield begin, "end", name[0][1:].lower(), ""
            continue
        tag = name[0].lower()
        yield begin, "start", tag, rest
        if tag in RAW and not rest.endswith("/"):
            if low is None:
                low = page.lower() if len(page.lower()) == n else re.sub("[A-Z]+", lambda m: m[0].lower(), page)
            close = low.find(f"</{tag}", at)
            at = n if close < 0 else close


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends at this place, outside of quoted values; -1 if it doesn't."""
    while True:
        found = STOP.search(page, at)
        if found is None:
            return -1
        if found[0] == ">":
            return found.start()
        before = page[at : found.start()].rstrip()
        if not before.endswith("="):
            at = found.end()
            continue
        close = page.find(found[0], found.end())
        if close < 0:
            return -1
        at = close + 1


@lru_cache(maxsize=4096)
def marks(name: str, rest: str) -> tuple[str, ...]:
    """What an element's attributes say, as features."""
    if "=" not in rest and "hidden" not in rest.lower():
        return ()
    out, group = [], "t" if name in TEXTS else "c"
    for m in ATTRIBUTE.finditer(rest):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append("hidden")
        elif kind == "role":
            out.append(f"role:{value.strip().lower()}")
        elif kind in ("class", "id", "itemprop"):
            for token in value.split()[:64]:
                words = [w.lower() for w in PARTS.findall(token)]
                if len(words) == 1:
                    out.append(f"{group}.{words[0]}")
                elif words:
                    out += [f"{group}.{words[0]}-", f"{group}.-{words[-1]}"]
    return tuple(dict.fromkeys(out))


class Path:
    """The open elements, and the sum of the weights of what they say, each thing once."""

    def __init__(self, weights: dict[str, float], trace: bool = False):
        self.weights, self.trace = weights, trace
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: Counter[str] = Counter()
        self.active: Counter[str] = Counter()
        self.total, self.named = weights.get("bias", 0.0), 0

    def push(self, name: str, rest: str, first: bool) -> None:
        """first: nothing stands between the element around and this one."""
        around = "article" if self.open["article"] else "main" if self.open["main"] else "named" if self.named else "none"
        above = self.stack[-1][0] if self.stack else ""
        # any page may have these two, or may not
        said = [] if name in ("html", "body") else [f"<{name}", f"<{name}@{around}"]
        said += marks(name, rest)
        # what lies in links and items, and in forms, depends on where
        if name in ("a", "li") or above == "form":
            said.append(f"<{above}<{name}{'' if first else '+'}")
        self.named += not MAIN_MARKS.isdisjoint(said)
        for f in said:
            self.active[f] += 1
            if self.active[f] == 1:
                self.total += self.weights.get(f, 0.0)
        self.stack.append((name, tuple(said)))
        self.open[name] += 1

    def pop(self) -> None:
        name, said = self.stack.pop()
        self.open[name] -= 1
        self.named -= not MAIN_MARKS.isdisjoint(said)
        for f in said:
            self.active[f] -= 1
            if not self.active[f]:
                del self.active[f]
                self.total -= self.weights.get(f, 0.0)

    def close(self, name: str) -> None:
        if self.open[name]:
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def make_room(self, name: str) -> None:
        """Ends the paragraph (list item) that a block (list item) can't stand in."""
        if not (self.open["p"] or name == "li" and self.open["li"]):
            return
        for k in range(len(self.stack) - 1, max(-1, len(self.stack) - THROUGH), -1):
            top = self.stack[k][0]
            if top == "p" and name != "li" or top == "li" and name == "li":
                while len(self.stack) > k:
                    self.pop()
                return
            if top not in INLINE:
                return


#: What holds the whole main text of a page if anything does: elements, and containers that have only such a name.
WHOLE = ("article", "main", "named")
MAIN_MARKS = frozenset(f"c.{w}" for w in MAIN.split())


@dataclass
class Piece:
    """A text or a tag; odds: of main text where it stands, before what the whole page says; around: which of WHOLE are."""

    place: int
    text: str | None
    sort: str
    odds: float
    around: tuple[bool, ...]
    said: tuple[str, ...] = field(default=())


def read(page: str, weights: dict[str, float], trace: bool = False) -> tuple[list[Piece], tuple[bool, ...]]:
    """The pieces of a page, and which of WHOLE hold a third or more of the words that may be main text.

    trace: pieces say what stands above them.
    """
    path, out, begun = Path(weights), [], False
    last: dict[str, int] = {}
    words: Counter[tuple[bool, ...]] = Counter()

    def piece(place: int, text: str | None, sort: str) -> None:
        around = path.open["article"] > 0, path.open["main"] > 0, path.named > 0
        out.append(Piece(place, text, sort, path.total, around, tuple(sorted(path.active)) if trace else ()))

    for place, kind, name, rest in tokens(page):
        if kind == "text":
            if name:
                begun = begun and not name.strip()
                piece(place, name, "text")
                if path.total > 0:
                    words[out[-1].around] += len(name.split())
            continue
        block = "br" if name == "br" else "inline" if name in INLINE else "frame" if name in FRAMES else "block"
        sort = f"{block}{'*' if name in ('a', 'li') else ''}"
        if kind == "end":
            begun = False
            piece(place, None, sort)
            path.close(name)
            continue
        if name in ENDS_P or name == "li":
            path.make_room(name)
        if name in EMBEDDED:
            if name not in last:
                last[name] = max((m.start() for m in re.finditer(f"</{name}", page, re.I)), default=-1)
            if place > last[name]:
                piece(place, None, sort)
                continue
        if name in VOID or rest.endswith("/") and name not in ENDS_P and name not in INLINE:
            piece(place, None, sort)
            continue
        path.push(name, rest, begun)
        begun = True
        piece(place, None, sort)
    return out, held_by(words)


def held_by(words: Counter[tuple[bool, ...]]) -> tuple[bool, ...]:
    """Which of WHOLE hold a third or more of the words."""
    total = sum(words.values())
    return tuple(total > 0 and 3 * sum(n for around, n in words.items() if around[k]) >= total for k in range(len(WHOLE)))


def learn(pages: list[tuple[str, list[tuple[int, int]]]]) -> dict[str, float]:
    """Weights from pages with the places where main text begins and ends, in order.

    Words with the same things above them are one example, with their number inside and outside of main text.
    """
    inside, outside, tag_in, tag_out = Counter(), Counter(), Counter(), Counter()
    for page, spans in pages:
        begins, ends = [a for a, _ in spans], [b for _, b in spans]
        within = lambda at: (k := bisect_right(begins, at) - 1) >= 0 and at < ends[k]  # noqa: E731, B023
        pieces, _ = read(page, {}, trace=True)
        words: Counter[tuple[bool, ...]] = Counter()
        for x in pieces:
            if x.text and within(x.place):
                words[x.around] += len(x.text.split())
        has = held_by(words)
        whole = spans[0][0] if spans else 0, spans[-1][1] if spans else 0
        for x in pieces:
            if x.text is None:
                (tag_in if whole[0] <= x.place < whole[1] else tag_out)[x.sort] += 1
            elif x.text.strip():
                said = (*x.said, *beyond(x, has))
                # a text counts by its logarithm, so that long ones don't outweigh all others
                (inside if within(x.place) else outside)[said] += log(1 + len(x.text.split()))
    examples = list({*inside, *outside})
    index = {f: i for i, f in enumerate(sorted({f for e in examples for f in e}))}
    x = np.zeros((len(examples), len(index) + 1))
    for row, e in enumerate(examples):
        x[row, [index[f] for f in e]] = 1.0
    x[:, -1] = 1.0
    a, b = (np.array([c[e] for e in examples]) for c in (inside, outside))
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (a - (a + b) * p) - RIDGE * w
        curve = (x * ((a + b) * p * (1 - p) + 1e-6)[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    out = {f: float(w[i]) for f, i in index.items()} | {"bias": float(w[-1])}
    for sort in {*tag_in, *tag_out}:
        out[f"tag:{sort}"] = log((tag_in[sort] + 0.5) / (tag_in[sort] + tag_out[sort] + 1.0))
    return out


def beyond(piece: Piece, has: tuple[bool, ...]) -> list[str]:
    """What the whole page says of a piece: that it stands outside of one of WHOLE that the page has."""
    return [f"no {name}" for name, there, around in zip(WHOLE, has, piece.around, strict=True) if there and not around]


@lru_cache(maxsize=1)
def default_weights() -> dict[str, float]:
    return learn([(page, spans) for page, spans, _ in labelled_pages()])


def best_run(scores: list[float]) -> tuple[int, int] | None:
    """The first and last place of the contiguous run with the largest sum above 0; None if there is none."""
    best, run, total, begin = 0.0, None, 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, k
        total += score
        if total > best:
            best, run = total, (begin, k)
    return run


def extract(page: str, weights: dict[str, float] | None = None) -> str:
    """The main text: blocks in page order, one to a line."""
    weights = default_weights() if weights is None else weights
    pieces, has = read(page, weights)
    far = {around: sum(weights.get(f, 0.0) for f in beyond(Piece(0, "", "", 0.0, around), has)) for around in {x.around for x in pieces}}
    odds = [x.odds + far[x.around] for x in pieces]
    scores = [0.0 if o <= 0 else weights.get(f"tag:{x.sort}", 0.0) if x.text is None else min(o, CAP) * len(x.text.split()) for x, o in zip(pieces, odds, strict=True)]
    run = best_run(scores)
    if run is None:
        return ""
    blocks, parts = [], []

    def close():
        whole = SPACES.sub(" ", "".join(parts)).strip()
        if whole:
            blocks.append(whole)
        parts.clear()

    for k in range(run[0], run[1] + 1):
        x = pieces[k]
        if x.text is not None:
            if odds[k] > 0:
                parts.append(html.unescape(x.text))
        elif x.sort == "br":
            parts.append(" ")
        elif not x.sort.startswith("inline"):
            close()
    close()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, html_col: str = "html", text_name: str = "text", size_name: str = "n_chars", weights: dict[str, float] | None = None) -> DataFrame:
    """The rows with the main text and its number of code points. weights: what `learn` gives, else of its own pages."""
    weights = default_weights() if weights is None else weights

    def run(columns):
        texts = [extract(x or "", weights) for x in columns[0].to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return appended(pages, [html_col], f"`{text_name}` string, `{size_name}` long", run)


def op5_html(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
