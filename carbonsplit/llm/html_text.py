"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a variable: content or not.  Its own features (tag, words of
class, id and role, text length, share of linked text) give a unary potential, and each
parent-child edge a pairwise one.  Sum-product messages from the leaves up and from the
root down give the exact marginal of every element.  The weights are learned by
gradient ascent on the log-likelihood of labelled pages.

Labelled pages are pages of the table in which one article element marks the content.
Each is learned from as it is and in a version with other containers and with added
menus, notices, adverts, forms and comments, so that the model does not rest on one tag.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by kind, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template iframe svg canvas object select option textarea datalist title".split())
#: Of these only the own end tag ends them: what they hold is not read as elements.
RAW = frozenset("script style noscript iframe textarea title".split())
#: Start tags that leave a drawing that was not closed, unless they stand in one of its parts that hold HTML.
LEAVES_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_IN_SVG = frozenset("foreignobject desc title".split())
MATH = frozenset("math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSED_BY_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
# Words that name parts of pages; what else a name says is learned.
PARTS = {
    "boilerplate": "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer copyright legal sidebar aside related recommended promo promotion ad ads advert adverts advertisement advertising adsense sponsor sponsored notice notices cookie cookies consent gdpr popup modal overlay form forms signup subscribe newsletter login search comment comments commentlist reply replies respond disqus share sharing social toolbar pagination pager tags contentinfo complementary".split(),
    "content": "article post entry content story main body text prose page".split(),
}
_PART_OF = {word: part for part, words in PARTS.items() for word in words}
#: First words of names that tell what a page has or lacks, not what the element is.
STATES = frozenset("has have is no not with without show hide hidden".split())
_BOILERPLATE_TAGS = frozenset("head nav header footer aside form button fieldset dialog menu".split())
#: Elements that say nothing by themselves: many of them must not outvote the part they stand in.
GENERIC = frozenset("p div section span ul ol li table tbody tr td".split())
#: Characters of an element's own text from which it counts as some, and as long; and of its paragraphs' from which it is prose.
SOME_TEXT, LONG_TEXT, PROSE = 32, 128, 256
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _name(text: str) -> list[str]:
    """The words of a name; none for a name that only states what the page has."""
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower())
    return [] if len(words) > 1 and words[0] in STATES else words


@dataclass
class Node:
    tag: str
    parent: int
    #: The words of each name among class, id and role.
    names: list[list[str]]
    children: list[int] = field(default_factory=list)
    own: int = 0
    linked: int = 0
    label: int | None = None


class Page(HTMLParser):
    """Elements in page order, and the pieces of text with their element; ``None`` ends a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", -1, [])]
        self.texts: list[tuple[int, str] | None] = []
        self.open = [0]
        self.unread: str | None = None
        #: Elements open within the unread one.
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.unread:
            if self.unread != "svg" or tag not in LEAVES_SVG or any(t in HTML_IN_SVG for t in self.inside):
                if tag not in VOID:
                    self.inside.append(tag)
                return
            self.unread = None
        if tag in UNREAD:
            self.unread, self.inside = tag, []
            return
        if tag in CLOSED_BY_BLOCK:
            self._close("p", ("article", "body", "button", "div", "li", "section", "td"))
        if tag in CLOSED_BY_OWN:
            for other in CLOSED_BY_OWN[tag]:
                self._close(other, SCOPES.get(tag, ()))
        if tag == "br":
            self.texts.append((self.open[-1], " "))
        elif tag not in INLINE:
            self.texts.append(None)
        if tag in VOID:
            return
        known = dict(attrs)
        names = [_name(word) for key in ("class", "id", "role") for word in (known.get(key) or "").split()]
        label = {"1": 1, "0": 0}.get(known.get("data-label") or "")
        node = Node(tag, self.open[-1], names, label=label)
        self.nodes[self.open[-1]].children.append(len(self.nodes))
        self.open.append(len(self.nodes))
        self.nodes.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # the slash means nothing in HTML, but closes drawings, formulas and what is in them
        if tag == "svg" or self.unread == "svg" and tag not in LEAVES_SVG:
            return
        self.handle_starttag(tag, attrs)
        if tag in MATH:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.unread:
            if self.unread not in RAW and tag in self.inside:
                while self.inside.pop() != tag:
                    pass
                return
            own = tag == self.unread
            if not own and (self.unread in RAW or all(self.nodes[i].tag != tag for i in self.open)):
                return
            self.unread = None
            if own:
                return
        if tag not in INLINE:
            self.texts.append(None)
        self._close(tag, ("table", "article") if tag in INLINE or tag == "p" else ())

    def handle_data(self, data: str) -> None:
        if self.unread or not data:
            return
        at = self.open[-1]
        self.texts.append((at, data))
        n = len(_SPACE.sub("", data))
        self.nodes[at].own += n
        if any(self.nodes[i].tag == "a" for i in self.open):
            self.nodes[at].linked += n

    def _close(self, tag: str, fence: tuple[str, ...]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.nodes[self.open[depth]].tag
            if name == tag:
                del self.open[depth:]
                return
            if name in fence:
                return


def parsed(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    return page


def features(page: Page) -> list[list[str]]:
    """Names of the features of each element."""
    total, linked = [n.own for n in page.nodes], [n.linked for n in page.nodes]
    for at in range(len(page.nodes) - 1, 0, -1):
        total[page.nodes[at].parent] += total[at]
        linked[page.nodes[at].parent] += linked[at]
    prose = [0] * len(page.nodes)
    for node in page.nodes[1:]:
        if node.tag == "p" and 4 * node.linked <= node.own:
            prose[node.parent] += node.own
    out = []
    for at, node in enumerate(page.nodes):
        named = [] if node.tag in GENERIC or node.tag in INLINE else [f"tag={node.tag}"]
        if node.own >= SOME_TEXT:
            named.append("long" if node.own >= LONG_TEXT else "some")
        if prose[at] >= PROSE:
            named.append("prose")
        if node.tag in _BOILERPLATE_TAGS:
            named.append("part=boilerplate")
        # of a name of several words the last one says what it is
        heads, others = {ws[-1] for ws in node.names if ws}, {w for ws in node.names for w in ws[:-1]}
        named += sorted({f"part={_PART_OF[w]}" for w in heads if w in _PART_OF} | {f"name={w}" for w in heads})
        named += sorted({f"of={_PART_OF[w]}" for w in others if w in _PART_OF} | {f"with={w}" for w in others})
        if total[at] and node.tag not in INLINE:
            named.append(f"links={round(4 * linked[at] / total[at])}")
        out.append(named)
    return out


@dataclass
class Model:
    """``weights`` add to an element's log-odds of content; ``edges`` are the log-potentials ``[parent, child]`` by kind of child."""

    weights: dict[str, float]
    edges: np.ndarray


#: Where learning starts and what it is weakly drawn to; a child is like its parent.
PRIOR = {"part=boilerplate": -2.0, "of=boilerplate": -1.0, "part=content": 1.0, "tag=article": 3.0, "tag=main": 3.0, "tag=body": -1.0, "tag=#page": -1.0, "long": 1.0, "links=4": -0.5}


def _normal(edges: np.ndarray) -> np.ndarray:
    """Each parent state's potentials as probabilities of the child: a child without evidence then sends nothing up."""
    return edges - np.log(np.exp(edges).sum(axis=2, keepdims=True))


PRIOR_EDGES = _normal(np.array([[[2.0, -2.0], [-2.0, 2.0]], [[2.5, -2.5], [-2.5, 2.5]], [[0.5, -0.5], [0.0, 0.0]]]))


def _kind(node: Node) -> int:
    """0 plain block, 1 inline, 2 a named part, which says little about what it stands in."""
    if node.tag in _BOILERPLATE_TAGS or node.tag in ("article", "main") or any(w in _PART_OF for words in node.names for w in words):
        return 2
    return 1 if node.tag in INLINE else 0


def messages(page: Page, unary: list[float], edges: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Log-odds of content: the marginal, what each element sends up (its own below included), and what comes down to it."""
    nodes = page.nodes
    below = list(unary)
    up = [0.0] * len(nodes)
    e = np.exp(edges).tolist()
    for at in range(len(nodes) - 1, 0, -1):
        k, odds = e[_kind(nodes[at])], math.exp(max(-60.0, min(60.0, below[at])))
        up[at] = math.log((k[1][0] + k[1][1] * odds) / (k[0][0] + k[0][1] * odds))
        below[nodes[at].parent] += up[at]
    down = [0.0] * len(nodes)
    marginal = list(below)
    for at in range(1, len(nodes)):
        parent = nodes[at].parent
        k, odds = e[_kind(nodes[at])], math.exp(max(-60.0, min(60.0, marginal[parent] - up[at])))
        down[at] = math.log((k[0][1] + k[1][1] * odds) / (k[0][0] + k[1][0] * odds))
        marginal[at] = below[at] + down[at]
    return marginal, below, down


def unary_of(page: Page, weights: dict[str, float]) -> list[float]:
    return [sum(weights.get(f, 0.0) for f in named) for named in features(page)]


def marginals(page: Page, model: Model) -> list[float]:
    """Exact log-odds of content for every element."""
    return messages(page, unary_of(page, model.weights), model.edges)[0]


def text_of(page: Page, content: list[bool]) -> str:
    """Blocks of the content elements: white space to one space, trimmed, joined by line feeds."""
    blocks, part = [], []
    for piece in [*page.texts, None]:
        if piece is None:
            block = _SPACE.sub(" ", "".join(part)).strip(" ")
            if block:
                blocks.append(block)
            part = []
        elif content[piece[0]]:
            part.append(piece[1])
    return "\n".join(blocks)


def extract(html: str | None, model: Model) -> str:
    page = parsed(html)
    return text_of(page, [x > 0 for x in marginals(page, model)])


# ---------------------------------------------------------------- training

_ARTICLE = re.compile(r"<article\b[^>]*>(.*)</article\s*>", re.S | re.I)
# Containers and parts that labelled pages are varied with, and names that say nothing of the sort.
_CONTAINERS = ('div', 'div class="wrap"', 'section', 'article', 'main', 'div class="post-content"', 'section id="article-body"', 'div role="main"', 'div class="entry"')
_OUTSIDE = ('nav', 'header', 'footer', 'aside', 'aside class="sidebar"', 'div class="menu"', 'div id="footer"', 'div class="ad"', 'div class="cookie-notice"', 'form', 'section id="comments"', 'div class="site-header"', 'div class="related-posts"')
_PLAIN = ("has-sidebar", "no-comments", "top-story", "bottom-line", "more", "lead", "wide", "side-by-side", "row", "first", "last", "intro", "with-ads", "box")
_INSIDE = ('div class="advert"', 'aside', 'section class="comments"', 'div class="notice"', 'form', 'div class="share"', 'nav', 'footer', 'header')


def labelled(html: str) -> str | None:
    """The page with its article marked, or None unless there is exactly one."""
    if len(re.findall(r"<article\b", html, re.I)) != 1 or not (found := _ARTICLE.search(html)):
        return None
    return f'{html[: found.start()]}<article data-label="1">{found[1]}</article>{html[found.end() :]}'


def varied(html: str, seed: int) -> str | None:
    """The page in another container, with parts added around and inside the article."""
    found = _ARTICLE.search(html)
    if not found:
        return None
    choose = random.Random(seed)
    words = re.sub(r"<[^>]*>", " ", found[1]).split()[:400] or ["text"]

    def part(opening: str) -> str:
        tag = opening.split()[0]
        inner = "".join(f"<p>{escape(' '.join(choose.choices(words, k=choose.randint(1, 25))))}</p>" for _ in range(choose.randint(1, 4)))
        if choose.random() < 0.4:
            inner = "<ul>" + "".join(f'<li><a href="#">{escape(choose.choice(words))}</a></li>' for _ in range(choose.randint(2, 6))) + "</ul>"
        return f'<{opening} data-label="0">{inner}</{tag}>'

    def plain(opening: str) -> str:
        """The opening with a name that does not tell a part, now and then."""
        if choose.random() < 0.6:
            return opening
        word = choose.choice(_PLAIN)
        return re.sub(r'class="', f'class="{word} ', opening) if "class=" in opening else f'{opening} class="{word}"'

    paragraphs = re.split(r"(?<=</p>)", found[1])
    paragraphs = [re.sub(r"<p>", lambda m: f"<{plain('p')}>", p) for p in paragraphs]
    if choose.random() < 0.2:  # an article may be a list of links
        paragraphs = [re.sub(r"(?s)<p([^>]*)>(.*)</p>$", r'<p\1><a href="#">\2</a></p>', p) if choose.random() < 0.8 else p for p in paragraphs]
    if choose.random() < 0.3:
        inner = plain("div")
        paragraphs = [f"<{inner}>", *paragraphs, "</div>"]
    for _ in range(choose.randint(0, 2)):
        paragraphs.insert(choose.randint(1, len(paragraphs)), part(choose.choice(_INSIDE)))
    container = plain(choose.choice(_CONTAINERS))
    before, after = ("".join(part(choose.choice(_OUTSIDE)) for _ in range(choose.randint(0, 3))) for _ in range(2))
    body = f'{before}<{container} data-label="1">{"".join(paragraphs)}</{container.split()[0]}>{after}'
    if choose.random() < 0.15:  # a fragment without anything around it
        return body
    return f"{html[: found.start()]}{body}{html[found.end() :]}"


def labels_of(page: Page) -> list[int]:
    """An element without a mark has that of its parent; the page itself is not content."""
    labels = [0]
    for node in page.nodes[1:]:
        labels.append(labels[node.parent] if node.label is None else node.label)
    return labels


def train(pages: list[str], rounds: int = 25, rate: float = 0.5, pull: float = 0.0005) -> Model:
    """Maximum posterior weights by Adagrad; without labelled pages the prior stays."""
    made = [p for n, html in enumerate(pages) for p in (labelled(html), varied(html, 2 * n), varied(html, 2 * n + 1)) if p]
    trees = [(page, labels_of(page), features(page)) for page in map(parsed, made)]
    model = Model(dict(PRIOR), PRIOR_EDGES.copy())
    squares: Counter = Counter()
    edge_squares = np.full((3, 2, 2), 1e-6)
    for _ in range(rounds if trees else 0):
        step: Counter = Counter()
        edge_step = np.zeros((3, 2, 2))
        e = np.exp(model.edges)
        for page, labels, named in trees:
            unary = [sum(model.weights.get(f, 0.0) for f in fs) for fs in named]
            marginal, below, down = messages(page, unary, model.edges)
            for at, node in enumerate(page.nodes):
                miss = labels[at] - 1 / (1 + math.exp(-max(-40.0, min(40.0, marginal[at]))))
                for f in named[at]:
                    step[f] += miss
                if at:
                    kind = _kind(node)
                    odds = e[kind][1][0] + e[kind][1][1] * math.exp(max(-40.0, min(40.0, below[at])))
                    zero = e[kind][0][0] + e[kind][0][1] * math.exp(max(-40.0, min(40.0, below[at])))
                    above = math.exp(max(-40.0, min(40.0, marginal[node.parent]))) * zero / odds
                    own = math.exp(max(-40.0, min(40.0, below[at])))
                    joint = e[kind] * np.array([[1.0, own], [above, above * own]])
                    edge_step[kind] -= joint / joint.sum()
                    edge_step[kind, labels[node.parent], labels[at]] += 1
        n = len(trees)
        for f, value in step.items():
            gradient = value / n - pull * (model.weights.get(f, 0.0) - PRIOR.get(f, 0.0))
            squares[f] += gradient**2
            model.weights[f] = model.weights.get(f, 0.0) + rate * gradient / math.sqrt(squares[f] + 1e-6)
        gradient = edge_step / n - pull * (model.edges - PRIOR_EDGES)
        edge_squares += gradient**2
        model.edges = _normal(model.edges + 0.1 * rate * gradient / np.sqrt(edge_squares))
    return model


def main_text(pages: DataFrame, max_pages: int = 200, max_chars: int = 50_000) -> DataFrame:
    """``page_id, url, text``: the main text of every page, one row per page.

    Character references are decoded; white space in a block (a line break included)
    becomes one space; blocks are trimmed and joined in page order by line feeds.  Null,
    empty and text-free pages give an empty text; unclosed and misnested elements are
    closed as HTML closes them; repeated rows give the same text; an empty table gives
    no rows; other columns do not matter.

    The model is learned from at most ``max_pages`` pages with one article element and
    at most ``max_chars`` characters, chosen by a hash of their content, equal pages
    counting once; every page is read whole.
    """
    usable = pages.filter(F.col("html").rlike("(?i)<article") & (F.length("html") <= max_chars)).select("html", F.xxhash64("html").alias("_order"))
    # numbers are ranked first, so that no partition sends pages that are not learned from
    chosen = usable.select("_order").distinct().orderBy("_order").limit(max_pages)
    sample = usable.join(F.broadcast(chosen), "_order").groupBy("_order").agg(F.max("html").alias("html"))
    model = train([r.html for r in sorted(sample.collect(), key=lambda r: r._order)])
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.edges))

    @F.pandas_udf("string")
    def extracted(html: pd.Series) -> pd.Series:
        own = Model(*shared.value)
        return pd.Series([extract(h, own) for h in html], dtype=object)

    return pages.select("page_id", "url", extracted("html").alias("text"))
