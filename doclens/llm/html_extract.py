"""Main text of web pages by a tree-structured graphical model over the DOM.

The block elements of a page are nodes with two states, content or not.  A
node's features give its own potential and each pair of parent and child adds
one; sum-product messages upward and downward give every node's marginal
probability of being content, and the text of nodes above one half is kept.  The
potentials are fitted by gradient ascent on the likelihood of labelled pages
(`html_training`), whose expected counts come from the same messages.

Pages are read from front to back in time linear in their length: a tag's end is
looked for once, a quote that is never closed is an ordinary character of its tag,
and an end tag searches the open elements only if one of its name is open.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_training import labelled_pages
from .token_counts import char_batches

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
QUIET = frozenset("noscript template svg annotation select optgroup option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture source math semantics mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder mstyle mspace".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table td th tr ul".split())
CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table div section article aside nav body html main header footer form".split())
TAGS = "nav header footer aside form article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption button fieldset menu body html dialog".split()
# Words in class, id and role attributes that speak against and for content, words that follow the former, words that turn them round.
AGAINST = frozenset("nav navbar navigation menu header masthead footer sidebar side aside cookie cookies consent notice banner ad ads advert adverts advertisement advertising promo promotion sponsor sponsored share sharing social comment comments reply replies respond disqus related recommended breadcrumb breadcrumbs form login signup subscribe newsletter widget popup modal overlay pager pagination toolbar search copyright contentinfo complementary alert".split())
FOR = frozenset("article content main post entry body story text maincontent articlebody prose page".split())
HOLDERS = frozenset("list box bar wrapper container area section block links item inner posts link wrap holder form widget".split())
WITHOUT = frozenset("no not with without has hide is".split())

_MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>?""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I | re.A) for name in RAW}
_WORDS = re.compile(r"[a-z]+")


def attributes_of(source: str) -> dict[str, str]:
    """Attributes of a tag by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value)
    return out


def speaks_against(token: str) -> int:
    """2 for a name like "sidebar", "site-footer" or "comment-list", 1 for another one with such a word, 0 otherwise."""
    words = _WORDS.findall(token)
    if not AGAINST.intersection(words) or WITHOUT.intersection(words):
        return 0
    return 2 if len(words) <= 3 and (words[-1] in AGAINST or (words[0] in AGAINST and words[-1] in HOLDERS)) else 1


class Quiet:
    """The open elements, from the outermost, whose text is never content; they are no nodes."""

    def __init__(self):
        self.names: list[str] = []
        self.open: Counter = Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.open[name] += 1

    def pop(self) -> str:
        name = self.names.pop()
        self.open[name] -= 1
        return name

    def clear(self) -> None:
        self.names.clear()
        self.open.clear()

    def takes(self, name: str, end: bool, attributes: str, outer: Counter) -> bool:
        """Whether a tag belongs to these elements, which it changes; they end where it can't, unless they are a template."""
        first = self.names[0]
        if end:
            if self.open[name]:
                while self.pop() != name:
                    pass
                return True
            if self.open["template"] or not (outer[name] or (name in INLINE and first != "noscript")):
                return True
            self.clear()
            return False
        if name in CLOSES_P and first not in ("template", "noscript") and not (self.open["template"] or self.open["foreignobject"] or self.open["desc"]):
            if first not in ("select", "optgroup", "option") or name != "hr":
                self.clear()
                return False
        if name in ("option", "optgroup") and self.names[-1] == "option":
            self.pop()
        if name not in VOID and name not in RAW and not attributes.endswith("/"):
            self.push(name)
        return True


class Page:
    """Block elements in page order: parent, tag, how their names speak, their own text pieces."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attributes = [-1], ["#root"], [{}]
        self.own, self.linked = [0], [0]
        self.blocks: list[tuple[int, list[str]]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, links, size = [0], 0, 0, len(source)
        open_: Counter = Counter()
        current: list[str] | None = None
        quiet = Quiet()

        def close(upto: int) -> None:
            while len(stack) > upto:
                open_[self.tag[stack.pop()]] -= 1

        while at < size:
            m = _TAG.match(source, at) if source[at] == "<" else None
            if m is None:
                other = _MARKUP.match(source, at)
                if other:
                    at = other.end()
                    continue
                end = source.find("<", at + 1)
                end = size if end < 0 else end
                if not quiet.names:
                    text = html.unescape(source[at:end])
                    node = stack[-1]
                    if current is None:
                        current = []
                        self.blocks.append((node, current))
                    current.append(text)
                    n = len(text.strip())
                    self.own[node] += n
                    if links:
                        self.linked[node] += n
                at = end
                continue
            at = m.end()
            name = m[2].lower()
            if quiet.names and quiet.takes(name, bool(m[1]), m[3], open_) and name not in RAW:
                continue
            if m[1]:
                if name == "a":
                    links = max(0, links - 1)
                elif open_[name]:
                    i = len(stack) - 1
                    while self.tag[stack[i]] != name:
                        i -= 1
                    close(i)
                    links, current = 0, None
                continue
            if name in RAW:
                closed = m[3].endswith("/") and (name not in ("script", "style", "textarea", "title") or (quiet.names and quiet.names[0] == "svg"))
                if not closed:
                    end = _RAW_END[name].search(source, at)
                    at = end.end() if end else size
                continue
            if name in QUIET:
                if not m[3].endswith("/"):
                    quiet.push(name)
            elif name == "head":
                pass
            elif name == "a":
                links += 1
            elif name == "br" or name == "hr":
                if current is not None:
                    current.append(" ")
            elif name in INLINE or name in VOID:
                pass
            else:
                current, links = None, 0
                if name in CLOSES_P and self.tag[stack[-1]] == "p":
                    close(len(stack) - 1)
                if any(open_[own] for own in CLOSES_OWN.get(name, ())):
                    for i in range(len(stack) - 1, 0, -1):
                        tag = self.tag[stack[i]]
                        if tag in CLOSES_OWN[name]:
                            close(i)
                            break
                        if tag in SCOPE:
                            break
                self.parent.append(stack[-1])
                self.tag.append(name)
                self.attributes.append(attributes_of(m[3]) if m[3].strip() else {})
                self.own.append(0)
                self.linked.append(0)
                if not m[3].rstrip().endswith("/"):
                    stack.append(len(self.tag) - 1)
                    open_[name] += 1

    def text(self, content: np.ndarray) -> str:
        """The blocks of content nodes, white space as one space, joined by one space."""
        out = []
        for node, pieces in self.blocks:
            if content[node]:
                words = "".join(pieces).split()
                if words:
                    out.append(" ".join(words))
        return " ".join(out)

    def features(self) -> np.ndarray:
        """Rows by node: tag, how its names and those of the elements around it speak, link share and amount of own and of all text below and how much of its own text is linked, its share of the page's text."""
        n = len(self.tag)
        own, linked = np.array(self.own, float), np.array(self.linked, float)
        below, below_linked = own.copy(), linked.copy()
        for i in range(n - 1, 0, -1):
            below[self.parent[i]] += below[i]
            below_linked[self.parent[i]] += below_linked[i]
        x = np.zeros((n, N_FEATURES))
        rest = x[:, len(TAGS) + 1 :]
        share = below / max(below[0], 1)
        tags = np.array(self.tag, dtype=object)
        # a form around a page's parts, or nearly all of its text, is a mere container
        parts = np.isin(tags, PARTS)
        for i in range(n - 1, 0, -1):
            parts[self.parent[i]] |= parts[i]
        held = (tags == "form") & (parts | (share > WHOLE))
        tags[held] = "div"
        for i, (tag, attributes) in enumerate(zip(tags, self.attributes)):
            x[i, _TAG_AT.get(tag, len(TAGS))] = 1
            if attributes:
                tokens = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower().split()
                # that it is a form says nothing of what it holds
                tokens = [t.replace("form", "") for t in tokens] if held[i] else tokens
                against = max(map(speaks_against, tokens), default=0)
                rest[i, 0], rest[i, 1] = against == 2, against == 1
                rest[i, 2] = not against and any(not FOR.isdisjoint(_WORDS.findall(t)) for t in tokens)
                rest[i, 3] = attributes.get("hidden", "false").lower() != "false" or attributes.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(attributes.get("style", "")))
        apart = np.isin(tags, SETS_APART)
        rest[:, 4] = 1
        rest[:, 5] = np.where(own > 0, linked / np.maximum(own, 1), 0)
        rest[:, 6] = np.where(below > 0, below_linked / np.maximum(below, 1), 0)
        rest[:, 7] = np.minimum(np.log1p(own) / 6, 1)
        rest[:, 8] = np.minimum(np.log1p(below) / 8, 1)
        rest[:, 9] = share
        rest[:, 10] = rest[:, 0] * share
        rest[:, 11] = rest[:, 2] * share
        rest[:, 12] = apart * share
        rest[:, 13] = rest[:, 6] * share
        rest[:, 20] = rest[:, 5] * rest[:, 7]
        # what stands around a node: names against, tags that set apart, names for, article or main, with their shares
        around = np.stack([rest[:, 0], apart, rest[:, 2], np.isin(self.tag, ("article", "main"))], axis=1)
        for i in range(1, n):
            p = self.parent[i]
            rest[i, 14:18] = np.maximum(rest[p, 14:18], around[p])
            rest[i, 18:20] = np.maximum(rest[p, 18:20], around[p, :2] * share[p])
        return x


_NONE = re.compile(r"display\s*:\s*none", re.I)
SETS_APART = ("nav", "header", "footer", "aside", "form", "menu", "fieldset", "button", "dialog")
_TAG_AT = {t: i for i, t in enumerate(TAGS)} | {"#root": TAGS.index("html")}
#: Elements that a page is divided by, as against those of a form, and the share of the text above which a form holds the page.
PARTS = ("h1", "main", "article", "nav", "header", "footer", "aside")
WHOLE = 0.8
N_FEATURES = len(TAGS) + 22


def levels(parent: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of a forest by depth, the roots (parent -1) first: nodes, their distinct parents, where each parent's children begin.

    Nodes stand in page order, so children of one parent are neighbours among those of their depth.
    """
    depth = [0] * len(parent)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    out = []
    for nodes in np.split(order, np.flatnonzero(np.diff(np.array(depth)[order])) + 1):
        begins = np.flatnonzero(np.diff(parent[nodes], prepend=-2))
        out.append((nodes, parent[nodes[begins]], begins))
    return out


def marginals(parent: np.ndarray, unary: np.ndarray, pair: np.ndarray, by_depth: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on a forest whose parents stand before their children, a depth at a time.

    unary: log potential of each node's two states; pair: log potential by state
    of parent and of child.  Gives each node's marginals and, for each node, the
    joint marginals of its parent and itself (0 for roots).
    """
    by_depth = levels(parent) if by_depth is None else by_depth
    up, sent, joint = unary.astype(float).copy(), np.zeros_like(unary, float), np.zeros((len(parent), 2, 2))
    for nodes, parents, begins in by_depth[:0:-1]:
        message = np.logaddexp(pair[:, 0] + up[nodes, :1], pair[:, 1] + up[nodes, 1:])
        sent[nodes] = message
        up[parents] += np.add.reduceat(message, begins)
    belief = up.copy()
    for nodes, _, _ in by_depth[1:]:
        # the parent's belief without what this child sent
        above = belief[parent[nodes]] - sent[nodes]
        belief[nodes] = up[nodes] + np.logaddexp(above[:, :1] + pair[0], above[:, 1:] + pair[1])
        both = above[:, :, None] + pair + up[nodes][:, None, :]
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        joint[nodes] = both / both.sum(axis=(1, 2), keepdims=True)
    power = np.exp(belief - belief.max(axis=1, keepdims=True))
    return power / power.sum(axis=1, keepdims=True), joint


def forest(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of several pages as one forest: parents, features, where each page begins (and the end)."""
    begins = np.cumsum([0, *[len(p.parent) for p in pages]])
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + b) for p, b in zip(pages, begins)])
    return parent, np.concatenate([p.features() for p in pages]), begins


class Model:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair

    def contents(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page which of its nodes are content."""
        if not pages:
            return []
        parent, x, begins = forest(pages)
        score = x @ self.weights
        belief, _ = marginals(parent, np.stack([np.zeros_like(score), score], axis=1), self.pair)
        return np.split(belief[:, 1] > 0.5, begins[1:-1])


def fit(pages: list[tuple[Page, np.ndarray]], steps: int = 200, rate: float = 0.4, penalty: float = 1e-4) -> Model:
    """Weights and pair potentials of greatest penalised likelihood on pages with a 0/1 label for each node, by gradients scaled by their past size."""
    weights, pair = np.zeros(N_FEATURES), np.zeros((2, 2))
    past, past_pair = np.full(N_FEATURES, 1e-8), np.full((2, 2), 1e-8)
    parent, x, _ = forest([p for p, _ in pages])
    y = np.concatenate([y for _, y in pages]).astype(int)
    by_depth, below = levels(parent), np.flatnonzero(parent >= 0)
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[parent[below]], y[below]), 1)
    for _ in range(steps):
        score = x @ weights
        belief, joint = marginals(parent, np.stack([np.zeros_like(score), score], axis=1), pair, by_depth)
        g = x.T @ (y - belief[:, 1]) - penalty * len(y) * weights
        gp = observed - joint.sum(axis=0) - penalty * len(y) * pair
        past += g * g
        past_pair += gp * gp
        weights += rate * g / np.sqrt(past)
        pair += rate * gp / np.sqrt(past_pair)
    return Model(weights, pair)


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """A page whose blocks inside an element marked data-main are content, but for those inside one marked data-off.

    An element without text of its own is content if most of the text below it is.
    """
    flags, page = [], Page(source)
    for i, attributes in enumerate(page.attributes):
        above = flags[page.parent[i]] if i else 0
        flags.append(0 if "data-off" in attributes else 1 if "data-main" in attributes else above)
    below = [[n * (not f), n * f] for n, f in zip(page.own, flags)]
    for i in range(len(flags) - 1, 0, -1):
        for k in (0, 1):
            below[page.parent[i]][k] += below[i][k]
    return page, np.array([f if n or off == on else int(on > off) for n, f, (off, on) in zip(page.own, flags, below)])


#: Labelled pages that the default model is fitted on.
TRAINING_PAGES = 300


@cache
def default_model() -> Model:
    return fit([labelled(source) for source in labelled_pages(TRAINING_PAGES)])


def main_texts(sources: list[str], model: Model) -> list[str]:
    pages = [Page(source) for source in sources]
    return [page.text(content) for page, content in zip(pages, model.contents(pages))]


#: Characters of html whose trees a task holds at a time, about.
BATCH_CHARS = 1 << 20


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars (code points): the main text of each whole page, empty if none.

    Null html counts as empty; every row is kept; other columns named text or
    n_chars are replaced.  Broken markup is read as browsers do: what an unclosed
    comment, tag or raw element swallows is no text.  Equal pages give equal
    texts, an empty table gives an empty table.  The model is fitted once, on the driver.
    """
    model = model or default_model()
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in kept) + ", text string, n_chars long"
    weights, pair = model.weights, model.pair

    def run(batches):
        own = Model(weights, pair)
        for pdf in batches:
            texts = [t for part in char_batches(pdf["__html"].tolist(), BATCH_CHARS) for t in main_texts(part, own)]
            yield pdf[kept].assign(text=texts, n_chars=[len(t) for t in texts])

    return pages.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(html_col), F.lit("")).alias("__html")).mapInPandas(run, schema)
