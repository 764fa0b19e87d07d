"""Labelled web pages, drawn at random from many builds: what the extraction of main text learns from.

A page is put together from parts whose label is known: the main text, in one of many containers, among menus, headers,
footers, sidebars, notices, adverts, forms, comments and hidden parts, each with names of its sort, alone or in compounds.
Names of containers that only say that a page has (or hasn't) a sidebar and the like are among the others.
"""

from __future__ import annotations

import random

#: Names of what is no main text, by sort.
NAMES = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar skip",
    "side": "sidebar aside widget widgets related recommended recommendations more popular",
    "top": "header masthead banner topbar branding",
    "bottom": "footer copyright colophon credits legal",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay",
    "form": "newsletter subscribe subscription signup login search register",
    "share": "share sharing social follow likes",
    "comment": "comment comments reply replies respond disqus discussion responses",
}
MAIN = "article content entry post story main body text articlebody"
STATES = "enabled disabled open opened closed on off active inactive"
ENDS = "box area container wrapper inner list section bar block links item group top left right wide"
BEGINS = "site page global top left right my the block"
PLAIN = "page wrapper container layout inner outer grid row col wrap site app root shell theme default dark large home view"
WORDS = "the river rose in night and by morning lower fields were under water again no one had seen it come so early since old mill stood there people went up hill with what they could carry".split()


class Builder:
    """One page: html, spans of main text, and the blocks they hold."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.size = rng, [], 0
        self.spans: list[tuple[int, int]] = []
        self.blocks: list[str] = []

    def add(self, *parts: str) -> None:
        for part in parts:
            self.html.append(part)
            self.size += len(part)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, *of):
        return self.rng.choice(of)

    def words(self, low: int, high: int) -> str:
        found = " ".join(self.rng.choice(WORDS) for _ in range(self.rng.randint(low, high)))
        return found.capitalize() + self.pick(".", ".", "!", "")

    # names

    def compound(self, name: str, other: str) -> str:
        end, begin, main = (self.rng.choice(x.split()) for x in (ENDS, BEGINS, MAIN))
        return self.pick(name, name, name, f"{name}-{end}", f"{begin}-{name}", f"{name}_{main}", f"{name}{self.rng.randint(1, 9)}", f"{name}-{other}", f"{name}{end.capitalize()}", f"{begin if self.chance(0.7) else main}-{name}")

    def named(self, sort: str) -> str:
        name = self.compound(self.rng.choice(NAMES[sort].split()), self.rng.choice(NAMES[sort].split()))
        return self.pick(f' class="{name}"', f" id={name}", f" class='{name} {self.rng.choice(PLAIN.split())}'")

    def aside(self) -> str:
        """A name by the way."""
        name = self.rng.choice(NAMES[self.rng.choice([*NAMES])].split())
        return self.pick(f"with-{name}", f"has-{name}", f"no-{name}", f"{name}-{self.rng.choice(STATES.split())}")

    def plain(self) -> str:
        names = [self.rng.choice(PLAIN.split()) for _ in range(self.rng.randint(0, 2))] + [f"x{self.rng.choice('abcdefgh')}{self.rng.randint(1, 99)}"] * self.chance(0.3) + [self.aside()] * self.chance(0.3)
        return f' class="{" ".join(names)}"' if names else ""

    # main text

    def inline(self, text: str) -> None:
        """Main text, now and then with a part in an inline element."""
        begin = self.size
        parts = text.split(" ")
        at = self.rng.randrange(len(parts))
        tag = self.pick("b", "em", "a href='/x'", "i", "strong", "span", "code") if self.chance(0.3) else None
        if tag and len(parts) > 1:
            head = " ".join(parts[:at])
            self.add(head + " " if head else "", f"<{tag}>", parts[at], f"</{tag.split()[0]}>")
            rest = " ".join(parts[at + 1 :])
            self.add(" " + rest if rest else "")
        else:
            self.add(text)
        self.spans.append((begin, self.size))
        self.blocks.append(text)

    def block(self, tag: str, text: str) -> None:
        name = f' class="{self.rng.choice(NAMES[self.rng.choice([*NAMES])].split() + MAIN.split() + ["lead", "intro", "first"])}"' if self.chance(0.12) else ""
        self.add(f"<{tag}{name}>")
        self.inline(text)
        self.add(f"</{tag}>")

    def paragraph(self) -> None:
        self.block(self.pick("p", "p", "p", "p", "div") if self.chance(0.9) else "blockquote", self.words(*self.pick((8, 60), (8, 60), (1, 8))))

    def main_text(self, whole: bool) -> None:
        if whole and self.chance(0.85):
            text = self.words(2, 8)
            if self.chance(0.15):
                self.add("<header>")
                self.block("h1", text)
                self.add("</header>")
            else:
                self.block(self.pick("h1", "h1", "h2"), text)
        for _ in range(self.rng.randint(2, 7)):
            kind = self.rng.random()
            if kind < 0.7:
                self.paragraph()
            elif kind < 0.78:
                self.block(self.pick("h2", "h3"), self.words(1, 6))
                self.paragraph()
            elif kind < 0.88:
                tag = self.pick("ul", "ol")
                self.add(f"<{tag}>")
                for _ in range(self.rng.randint(2, 5)):
                    self.block("li", self.words(2, 14))
                self.add(f"</{tag}>")
            elif kind < 0.92:
                self.add("<figure><img src=a>")
                self.block("figcaption", self.words(3, 9))
                self.add("</figure>")
            elif kind < 0.95:
                self.add("<table><tr>")
                for _ in range(self.rng.randint(1, 3)):
                    self.block("td", self.words(1, 6))
                self.add("</tr></table>")
            else:
                name = self.rng.choice(MAIN.split() + PLAIN.split())
                first = self.rng.choice(NAMES[self.rng.choice([*NAMES])].split())
                self.add(self.pick(f"<div class='{first}-price {name}'>", f"<div class='{name}'>", "<section>"))
                opened = self.html[-1][1:4] == "div"
                self.paragraph()
                self.add("</div>" if opened else "</section>")
            if self.chance(0.15):
                self.junk(within=True)

    # what is no main text

    def links(self, n: int = 5) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(self.rng.randint(2, n)))

    def prose(self) -> str:
        return "".join(self.pick(f"<p>{self.words(3, 30)}</p>", f"<div>{self.words(3, 20)}</div>", f"<p>{self.words(2, 9)} <a href=/>{self.words(1, 4)}</a></p>") for _ in range(self.rng.randint(1, 4)))

    def fields(self) -> str:
        return f"<label>{self.words(1, 3)}</label><input name=q>" + f"<button>{self.words(1, 2)}</button>" + (f"<select><option>{self.words(1, 2)}</option></select>" if self.chance(0.3) else "") + "".join(f"<p>{self.words(1, 12)}</p>" for _ in range(self.rng.randint(0, 4)))

    def comments(self) -> str:
        out = f"<h2>{self.words(1, 3)}</h2>"
        for _ in range(self.rng.randint(1, 5)):
            tag = self.pick("div class=comment", "article", "li", "div", "article class=comment-body", "section")
            out += f"<{tag}>{self.pick('', '<header><b>Ann</b></header>', '<footer>Ann</footer>')}<p>{self.words(2, 40)}</p></{tag.split()[0]}>"
        return out

    def junk(self, within: bool = False) -> None:
        sort = self.pick("ad", "side", "share", "notice", "form", "ad", "hidden", "related", "raw", "raw", "bottom") if within else self.pick("ad", "menu", "side", "top", "bottom", "notice", "form", "share", "hidden", "list", "raw", "raw", "raw")
        tag = self.pick("div", "div", "section", "div")
        if sort == "menu":
            self.add(self.pick(f"<nav><ul>{self.links()}</ul></nav>", f"<div{self.named('menu')}><ul>{self.links()}</ul></div>", f"<ul{self.named('menu')}>{self.links()}</ul>", f"<div role=navigation>{self.links()}</div>", f"<nav>{self.words(1, 5)}</nav>"))
        elif sort == "list":
            self.add(f"<ul>{self.links(7)}</ul>")
        elif sort in ("side", "related"):
            inner = self.pick(f"<h3>{self.words(1, 3)}</h3><ul>{self.links()}</ul>", self.prose(), f"<article><h2>{self.words(2, 6)}</h2><p>{self.words(4, 25)}</p></article>", f"<p>{self.words(4, 40)}</p>")
            self.add(self.pick(f"<aside>{inner}</aside>", f"<{tag}{self.named('side')}>{inner}</{tag}>", f"<aside{self.named('side')}>{inner}</aside>", f"<div role=complementary>{inner}</div>"))
        elif sort == "top":
            inner = self.pick(f"<h1>{self.words(1, 3)}</h1>", f"<a href=/>{self.words(1, 2)}</a>", f"<p>{self.words(2, 8)}</p>") + (f"<nav><ul>{self.links()}</ul></nav>" if self.chance(0.5) else "")
            self.add(self.pick(f"<header>{inner}</header>", f"<header{self.named('top')}>{inner}</header>", f"<div{self.named('top')}>{inner}</div>", f"<div role=banner>{inner}</div>"))
        elif sort == "bottom":
            inner = self.pick(f"<p>{self.words(3, 14)}</p>", self.words(3, 14), f"<ul>{self.links()}</ul>")
            self.add(self.pick(f"<footer>{inner}</footer>", f"<div{self.named('bottom')}>{inner}</div>", f"<div role=contentinfo>{inner}</div>", f"<footer{self.named('bottom')}>{inner}</footer>"))
        elif sort == "form":
            inner = self.fields()
            self.add(self.pick(f"<form>{inner}</form>", f"<form action=/>{self.prose()}</form>", f"<div{self.named('form')}><p>{self.words(3, 9)}</p><form>{inner}</form></div>", f"<form{self.named('form')}>{inner}</form>", f"<div{self.named('form')}>{self.words(2, 8)}</div>"))
        elif sort == "hidden":
            inner = self.pick(self.prose(), f"<main>{self.words(3, 9)}</main>", self.words(3, 12))
            self.add(self.pick(f"<div hidden>{inner}</div>", f'<div aria-hidden="true">{inner}</div>', f'<div style="display: none">{inner}</div>', f"<p hidden>{self.words(2, 6)}</p>"))
        elif sort == "raw":
            inner = self.words(2, 8)
            self.add(self.pick(f"<noscript>{inner}</noscript>", f"<svg><text>{inner}</text></svg>", f"<template><p>{inner}</p></template>", f"<iframe>{inner}</iframe>", f"<object>{inner}</object>", f"<canvas>{inner}</canvas>", f"<dialog>{inner}</dialog>", f"<video>{inner}</video>", f"<audio>{inner}</audio>", f"<math><mi>{inner}</mi></math>", f"<menu>{self.links()}</menu>", f"<button>{inner}</button>", f"<fieldset>{inner}</fieldset>", f"<select><option>{inner}</option></select>", f"<label>{inner}</label>"))
        else:
            inner = self.pick(self.prose(), self.words(3, 20), f"<p>{self.words(3, 25)}</p>", f"<ul>{self.links()}</ul>")
            self.add(f"<{tag}{self.named(sort)}>{inner}</{tag}>")

    def comment_part(self) -> None:
        inner = self.comments()
        self.add(self.pick(f"<section{self.named('comment')}>{inner}</section>", f"<div{self.named('comment')}>{inner}</div>", f"<ol{self.named('comment')}>{inner}</ol>"))

    def container(self) -> tuple[str, str]:
        one, two = self.rng.choice(MAIN.split()), self.rng.choice(MAIN.split())
        extra = f" {self.aside()}" if self.chance(0.4) else ""
        tag = self.pick(
            "<article>", "<article>", "<article>", f"<article{self.plain()}>", "<main><article>", "<main>", "<main>", f'<div class="{one}{extra}">', f'<div id={one} class="{self.aside()}">', f'<div class="{one}-{two}{extra}">',
            f'<section class="{one}-{two}{extra}">', f'<div id="{one}-{self.rng.choice(ENDS.split() + PLAIN.split())}">', f'<div class="{one}-{self.rng.choice(ENDS.split())}-{two}">', "<div role=main>", '<div itemprop="articleBody">', f'<main><div class="{one}">', f"<div{self.plain()}>", f"<div{self.plain()}>", "<section>", "<table><tr><td>", "", f'<div id="{one}">', f'<article class="{one} {self.aside()}">',
        )
        close = "".join(f"</{t.split()[0].rstrip('>')}>" for t in reversed(tag.split("<")[1:]))
        return tag, close

    def page(self) -> tuple[str, list[tuple[int, int]], str]:
        self.add(f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head><body{self.plain()}>")
        closes = []
        early = self.rng.randint(0, 3)
        for _ in range(early):
            self.junk()
        for _ in range(self.rng.randint(0, 2)):
            tag = self.pick("div", "div", "section", "form action=/", "form id=aspnet", "table><tr><td")
            self.add(f"<{tag}{self.plain() if '>' not in tag else ''}>")
            closes.append("</td></tr></table>" if "table" in tag else f"</{tag.split()[0]}>")
            for _ in range(self.rng.randint(0, 1)):
                self.junk()
        tag, close = self.container()
        if not tag and closes and closes[-1] == "</form>":
            tag, close = "<div>", "</div>"
        self.add(tag)
        self.main_text(True)
        self.add(close)
        for _ in range(self.rng.randint(0, 2)):
            self.junk()
        marked = any(x in tag for x in ("article", "main", *(f'{q}{n}{r}' for n in MAIN.split() for q in '" ' for r in '" ')))
        if marked and self.chance(0.3):
            self.add(self.pick(f"<p>{self.words(1, 8)}</p>", f"<div>{self.words(1, 6)}</div>", f"<p>{self.words(1, 4)} <a href=/>{self.words(1, 3)}</a></p>"))
        if self.chance(0.4):
            self.comment_part()
        for c in reversed(closes):
            self.add(c)
            if self.chance(0.4):
                self.junk()
        if self.chance(0.6):
            self.add(f"<footer>{self.words(2, 12)}</footer>")
        self.add("</body></html>")
        return "".join(self.html), self.spans, "\n".join(self.blocks)


def labelled_pages(number: int = 2500, seed: int = 1) -> list[tuple[str, list[tuple[int, int]], str]]:
    """Pages, the places where main text begins and ends in them, and the text."""
    rng = random.Random(seed)
    return [Builder(rng).page() for _ in range(number)]
