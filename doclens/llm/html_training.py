"""Labelled pages that the content model is fitted on, drawn from a grammar of layouts.

A page is a main part in one of several containers (article, main, marked or
neutral div, table cell, bare body) among menus, headers, notices, adverts, forms,
sidebars, reader comments and footers; now and then one form holds all of them, or
the paragraphs of the main part are links.  Parts vary in number, order, length and
markup; words of class attributes stand on the wrong element now and then, so that
no word alone decides.  Elements with data-main begin content, those with data-off
end it.
"""

from __future__ import annotations

import random

# Names of classes as found on pages.
MAIN_CLASSES = ("content", "post", "entry", "article-body", "main-content", "story", "text", "post header-image", "article has-sidebar", "entry no-comments", "page-content", "article-with-banner")
NEUTRAL_CLASSES = ("row", "col-8", "inner", "wrapper", "container", "box", "layout", "site", "outer fixed-header", "with-sidebar", "page no-ads", "grid")
PART_CLASSES = ("article-meta", "post-meta", "lead", "intro", "figure", "note", "quote", "chapter", "step", "abstract", "share-of-costs", "form-of-words", "comment-on-method", "menu-of-the-day")
OFF = {
    "menu": ("nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "toolbar"),
    "header": ("header", "masthead", "site-header", "top-header", "page-header"),
    "footer": ("footer", "site-footer", "page-footer", "copyright"),
    "side": ("sidebar", "aside", "side", "left-sidebar", "widget", "sidebar-box"),
    "ad": ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-box"),
    "notice": ("notice", "cookie-notice", "cookie-banner", "consent", "alert", "popup", "notice-bar"),
    "comments": ("comments", "reader-comments", "comment-list", "respond", "replies", "disqus"),
    "form": ("newsletter", "subscribe", "search", "login", "signup-form", "contact-form"),
    "related": ("related", "recommended", "related-posts", "pagination", "pager"),
    "share": ("share", "social", "share-links", "sharing"),
}


class Maker:
    """One page, from its own random numbers."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        return " ".join("".join(self.rng.choice("abcdefghiklmnoprstuvw") for _ in range(self.rng.randint(2, 9))) for _ in range(n)).capitalize() + self.rng.choice((".", ".", "", "!"))

    def maybe(self, chance: float) -> bool:
        return self.rng.random() < chance

    def marked(self, names, chance: float = 1.0) -> str:
        if not self.maybe(chance):
            return ""
        name = self.rng.choice(names)
        return f" {self.rng.choice(('class', 'class', 'id'))}='{name}'" if " " not in name else f" class='{name}'"

    def links(self) -> str:
        return "".join(f"<li><a href=/{i}>{self.words(1, 3)}</a></li>" for i in range(self.rng.randint(2, 9)))

    def prose(self) -> str:
        low, high = self.rng.choice(((3, 12), (12, 50), (40, 160)))
        text = self.words(low, high)
        if self.maybe(0.3):
            text += f" <a href=/x>{self.words(1, 3)}</a> <b>{self.words(1, 4)}</b>"
        return text + (f"<br>{self.words(3, 20)}" if self.maybe(0.15) else "")

    def block(self, deep: bool = True) -> str:
        kind = self.rng.choice(("p",) * 9 + ("h", "list", "quote", "pre", "table", "dl", "figure", "details", "div", "section", "part", "open", "steps"))
        if kind == "h":
            level = self.rng.randint(2, 4)
            return f"<h{level}>{self.words(2, 8)}</h{level}>"
        if kind in ("list", "steps"):
            tag = "ul" if kind == "list" else "ol"
            linked = self.maybe(0.2)
            return f"<{tag}>" + "".join(f"<li>{self.words(2, 25)}{f' <a href=/s>{self.words(1, 3)}</a>' if linked else ''}</li>" for _ in range(self.rng.randint(2, 6))) + f"</{tag}>"
        if kind == "quote":
            return f"<blockquote>{f'<p>{self.prose()}</p>' if self.maybe(0.5) else self.prose()}</blockquote>"
        if kind == "pre":
            return f"<pre>{self.words(4, 40)}</pre>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.rng.randint(2, 5))) + "</table>"
        if kind == "dl":
            return "<dl>" + "".join(f"<dt>{self.words(1, 3)}</dt><dd>{self.words(4, 20)}</dd>" for _ in range(self.rng.randint(1, 4))) + "</dl>"
        if kind == "figure":
            return f"<figure><img src=x><figcaption>{self.words(3, 14)}</figcaption></figure>"
        if kind == "details":
            return f"<details><summary>{self.words(1, 5)}</summary>{f'<p>{self.prose()}</p>' if self.maybe(0.5) else self.prose()}</details>"
        if kind == "part":
            return f"<div{self.marked(PART_CLASSES)}>{self.words(2, 30)}</div>"
        if kind in ("div", "section") and deep:
            return f"<{kind}{self.marked(PART_CLASSES + NEUTRAL_CLASSES, 0.4)}>" + "".join(self.block(False) for _ in range(self.rng.randint(1, 3))) + f"</{kind}>"
        if kind == "open":
            return f"<p>{self.prose()}"
        if self.maybe(0.08):
            return self.linked()
        return f"<p>{self.prose()}</p>"

    def linked(self) -> str:
        """A paragraph that is one link."""
        return f"<p><a href=/x>{self.words(*self.rng.choice(((12, 50), (40, 160))))}</a></p>"

    def off(self, kind: str, inside: bool = False) -> str:
        """A part that is no content."""
        mark, flag = self.marked(OFF[kind], 0.9), " data-off" if inside else ""
        short, para = self.words(2, 10), f"<p>{self.words(*self.rng.choice(((4, 60), (40, 160))))}</p>"
        if kind == "menu":
            tag = self.rng.choice(("nav", "nav", "ul", "div", "menu"))
            inner = self.links() if tag in ("ul", "menu") else f"<ul>{self.links()}</ul>" if self.maybe(0.8) else " ".join(f"<a href=/m>{self.words(1, 2)}</a>" for _ in range(5))
            return f"<{tag}{'' if tag == 'nav' and self.maybe(0.6) else mark or ' class=menu'}{flag}>{inner}</{tag}>"
        if kind == "header":
            tag = self.rng.choice(("header", "header", "div"))
            return f"<{tag}{mark if tag == 'div' or self.maybe(0.3) else ''}{flag}><div class=logo>{short}</div>{f'<ul>{self.links()}</ul>' if self.maybe(0.5) else ''}</{tag}>"
        if kind == "footer":
            tag = self.rng.choice(("footer", "footer", "div"))
            return f"<{tag}{(mark or ' id=footer') if tag == 'div' or self.maybe(0.3) else ''}{flag}>{self.rng.choice((short, f'<p>{short}</p>', f'&copy; {short} <a href=/i>{short}</a>', f'<p>{self.words(5, 40)}</p><ul>{self.links()}</ul>'))}</{tag}>"
        if kind == "side":
            tag = self.rng.choice(("aside", "aside", "div", "section"))
            return f"<{tag}{(mark or ' class=sidebar') if tag != 'aside' or self.maybe(0.5) else ''}{flag}><h3>{short}</h3>{self.rng.choice((para, f'<ul>{self.links()}</ul>', para + f'<ul>{self.links()}</ul>'))}</{tag}>"
        if kind == "ad":
            return f"<{self.rng.choice(('div', 'div', 'section', 'aside'))}{mark or ' class=ad'}{flag}>{self.rng.choice((short, para, self.words(6, 40)))}</div>"
        if kind == "notice":
            return f"<div{mark or ' class=notice'}{flag}>{self.rng.choice((para, short, self.words(6, 30)))}{f'<button>{self.words(1, 2)}</button>' if self.maybe(0.5) else ''}</div>"
        if kind == "comments":
            one = lambda: self.rng.choice((f"<div class=comment><p>{self.words(3, 60)}</p></div>", f"<article class=comment><p>{self.words(3, 60)}</p></article>", f"<li class=comment>{self.words(3, 60)}</li>", f"<p>{self.words(3, 60)}</p>"))
            tag = self.rng.choice(("section", "div"))
            return f"<{tag}{mark or ' id=comments'}{flag}>{f'<h3>{short}</h3>' if self.maybe(0.6) else ''}" + "".join(one() for _ in range(self.rng.randint(1, 5))) + f"</{tag}>"
        if kind == "form":
            return f"<form{mark}{flag}><label>{short}</label><input><p>{short}</p><button>{self.words(1, 2)}</button></form>"
        if kind == "related":
            return f"<{'section' if self.maybe(0.5) else 'div'}{mark or ' class=related'}{flag}><h3>{short}</h3><ul>{self.links()}</ul></div>"
        return f"<div{mark or ' class=share'}{flag}><a href=/t>{self.words(1, 1)}</a> <a href=/f>{self.words(1, 1)}</a></div>"

    def closed(self, part: str) -> str:
        """The part with the end tag that its start tag wants."""
        tag = part[1:].split(" ")[0].split(">")[0]
        return part if part.endswith(f"</{tag}>") else part[: part.rindex("</")] + f"</{tag}>"

    def page(self) -> str:
        blocks = [f"<h1>{self.words(2, 9)}</h1>"] if self.maybe(0.75) else []
        wholly = self.maybe(0.06)
        blocks += [self.linked() if wholly else self.block() for _ in range(self.rng.choice((1, 1, 2, 3, 4, 6, 9)))]
        kind = self.rng.choice(("article", "article", "main", "both", "class", "class", "section", "neutral", "neutral", "table", "bare", "bare", "text", "raw"))
        if kind not in ("bare", "text", "raw"):
            for off in self.rng.sample(("share", "ad", "side", "form", "menu", "footer", "related"), self.rng.choice((0, 0, 0, 1, 1, 2))):
                blocks.insert(self.rng.randint(1, len(blocks)), self.closed(self.off(off, True)))
        inner = "".join(blocks)
        odd = self.marked(MAIN_CLASSES + NEUTRAL_CLASSES, 0.3)
        main = {
            "article": f"<article data-main{odd}>{inner}</article>",
            "main": f"<main data-main{odd}>{inner}</main>",
            "both": f"<main data-main><article{odd}>{inner}</article></main>",
            "class": f"<div data-main{self.marked(MAIN_CLASSES)}>{inner}</div>",
            "section": f"<section data-main>{inner}</section>",
            "neutral": f"<div data-main{self.marked(NEUTRAL_CLASSES, 0.3)}>{inner}</div>",
            "table": f"<table><tr><td data-main>{inner}</td>{self.rng.choice(('', f'<td class=sidebar><ul>{self.links()}</ul></td>'))}</tr></table>",
            "bare": "".join(b.replace(">", " data-main>", 1) for b in blocks),
            "text": f"<div data-main>{self.prose()}</div>",
            "raw": "",
        }[kind]
        alone = self.maybe(0.2)
        if kind == "raw":
            after = [] if alone else [self.closed(self.off(k, True)) for k in self.rng.sample(("menu", "header", "footer", "side", "ad", "comments"), self.rng.choice((0, 1, 2)))]
            tag = self.rng.choice(("html", "body"))
            return f"<{tag} data-main>{self.prose()}{'<br>' + self.prose() if self.maybe(0.4) else ''}" + "".join(blocks[1:] if self.maybe(0.3) else []) + "".join(after)
        before = [] if alone else [self.closed(self.off(k)) for k in self.rng.sample(("menu", "header", "ad", "notice", "form"), self.rng.choice((0, 1, 2, 2, 3)))]
        after = [] if alone else [self.closed(self.off(k)) for k in self.rng.sample(("comments", "footer", "side", "ad", "related", "form", "notice", "menu"), self.rng.choice((0, 1, 2, 3, 4)))]
        if self.maybe(0.3) and kind != "bare":
            main = f"<div{self.marked(NEUTRAL_CLASSES, 0.7)}>{main}{self.closed(self.off('side')) if self.maybe(0.3) else ''}</div>"
        body = "".join(before) + main + "".join(after)
        if self.maybe(0.1) and "<form" not in body:
            body = f"<form{self.rng.choice((' id=aspnetForm', ' method=post action=/', ' class=page'))}>{body}</form>"
        head = "<!DOCTYPE html><html><head><title>t</title></head>" if self.maybe(0.7) else ""
        return head + (f"<body{self.marked(NEUTRAL_CLASSES, 0.2)}>{body}</body></html>" if self.maybe(0.85) else body)


def labelled_pages(count: int, seed: int = 1) -> list[str]:
    """`count` pages; other seeds give other pages."""
    return [Maker(seed * 1_000_003 + i).page() for i in range(count)]
