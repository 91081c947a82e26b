"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' shape.

A page is read once into blocks: runs of text between block-level tags. `features` gives the shape of each: its number of
words, the share of them in links, the same of the blocks before and after it, and the share of links in the box it lies in.
Weaker marks say where it stands: in an article and how much of the page such articles hold, in an element
whose tag is not for content, in one whose names speak of something else wholly (`cookie-notice`) or in part (`related-work`),
in a heading, beside a copyright sign. A tree (CART) trained on `labelled()`, a small table of blocks of pages made by rule, half
of them without articles, keeps or drops each block. Scripts, styles, comments in the markup and titles are no text at all.

Defined cases: a null or empty page has an empty text and 0 characters; text outside of any tag is a block; an unclosed
tag or comment at the end is dropped; whole pages are read; equal rows give equal rows; a null id or url stays null;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_rows, text_sizes, texts_of

#: HTML elements by role, and the words in names of elements that are not content.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mspace mstyle mpadded mphantom msub msup msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg object canvas annotation annotation-xml".split())
#: Of these, the ones that stand within a line.
UNSEEN = frozenset("annotation annotation-xml".split())
BOXES = frozenset("article aside blockquote body button center details dialog div dl fieldset figure footer form header hgroup main menu nav ol search section select table ul".split())
ASIDE_TAGS = frozenset("aside button dialog footer form header menu nav search select".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr privacy notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup signin login register sidebar sidenav widget widgets menu nav navigation navbar topnav breadcrumb breadcrumbs topbar toolbar masthead header footer "
    "colophon copyright comment comments commentlist reply replies respond responses disqus discussion feedback reactions share sharing social follow related recommended recommendations trending popular pagination pager skip search".split()
)
#: Words of names that say nothing of their own, so that `user-feedback` and `site-footer` speak as their other word does.
PLAIN_WORDS = frozenset("user users reader readers site page main box block list section area wrap wrapper container inner outer top bottom left right global primary secondary post posts article bar item row col column group thread content links form".split())
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset(("article", "articlebody", "main", "post", "entry"))

_TAG = re.compile(r"""<!--(?P<note>.*?)(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_LABEL = re.compile(r'data-keep="(\d)"')


@dataclass(frozen=True)
class Box:
    """An open element, with what its ancestors' marks add up to."""

    tag: str = ""
    number: int = 0
    article: bool = False
    aside: bool = False
    named: bool = False
    hinted: bool = False
    label: int = -1


@dataclass
class Block:
    text: str
    words: int
    linked: int
    box: Box
    heading: bool


def marks(name: str, more: str) -> tuple[bool, bool, bool, bool]:
    """What an element's tag and names say of it: (not content by tag, by names wholly, by names in part, an article)."""
    tag = name in ASIDE_TAGS or bool(more and _HIDDEN.search(more))
    names = [m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(more)] if more and name != "body" else []
    parts = [{w for w in re.split(r"[^a-z]+", x) if w} for n in names for x in n.lower().split()]
    whole = any(p & ASIDE_WORDS and p <= ASIDE_WORDS | PLAIN_WORDS for p in parts)
    some = any(p & ASIDE_WORDS for p in parts)
    return tag, whole, some and not whole, name in ARTICLE_TAGS or any(p & ARTICLE_WORDS and not p & ASIDE_WORDS for p in parts)


@dataclass
class _Reader:
    """Goes through a page once; the open boxes are a stack, as pages close them carelessly."""

    blocks: list[Block] = field(default_factory=list)
    boxes: list[Box] = field(default_factory=lambda: [Box()])
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    own: tuple[bool, bool, bool, bool] = (False,) * 4
    made: int = 0
    heading: bool = False
    linking: bool = False
    unclosed: bool = False  # a link without its end, which ends with its block

    def flush(self) -> None:
        """Ends a block; a paragraph's or an item's own names hold for this one block."""
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            tag, named, hinted, _ = self.own
            box = self.boxes[-1]
            if any(self.own):
                box = replace(box, aside=box.aside or tag, named=box.named or named, hinted=box.hinted or hinted)
            self.blocks.append(Block(text, len(text.split()), len(html.unescape(" ".join(self.links)).split()), box, self.heading))
        self.parts, self.links, self.own = [], [], (False,) * 4
        self.linking = self.linking and not self.unclosed

    def text(self, part: str) -> None:
        self.parts.append(part)
        if self.linking:
            self.links.append(part)

    def open(self, name: str, more: str, unclosed: bool = False) -> None:
        if name == "a":
            self.linking, self.unclosed = True, unclosed
        if name == "br":
            self.parts.append(" ")
        if name in INLINE:
            return
        self.flush()
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            self.heading = True
        if more.endswith("/"):
            return
        own = marks(name, more) if more or name in ASIDE_TAGS or name in ARTICLE_TAGS else (False,) * 4
        if name not in BOXES:
            self.own = own
            return
        above = self.boxes[-1]
        tag, named, hinted, article = own
        if above.article and not above.aside and not above.named and name == "header":
            tag = False  # an article's own header holds its title
        self.made += 1
        m = _LABEL.search(more) if more else None
        self.boxes.append(Box(name, self.made, above.article or (article and not tag and not named), above.aside or tag, above.named or named, above.hinted or hinted, int(m[1]) if m else above.label))

    def close(self, name: str) -> None:
        if name == "a":
            self.linking = False
        if name in INLINE:
            return
        self.flush()
        if len(name) == 2 and name[0] == "h":
            self.heading = False
        if name in BOXES:
            for i in range(len(self.boxes) - 1, 0, -1):
                if self.boxes[i].tag == name:
                    del self.boxes[i:]
                    break


#: The next link's begin or end.
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    r, at = _Reader(), 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            r.text(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            r.close(name)
        elif name in RAW:
            if name not in UNSEEN:
                r.flush()
            if not (m["more"] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        else:
            r.open(name, m["more"] or "", name == "a" and not ((after := _ANCHOR.search(page, at)) and after[1]))
    r.text(page[at:])
    r.flush()
    return r.blocks


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "box_links", "heading", "aside", "named", "hinted", "article", "in_articles", "rights")


def features(page: list[Block]) -> np.ndarray:
    """A row for each block; beyond the ends stand empty blocks."""
    words, linked = np.array([b.words for b in page], float), np.array([min(b.words, b.linked) for b in page], float)
    w, d = np.concatenate([[0], words, [0]]), np.concatenate([[0], linked / words, [0]])
    box = np.unique([b.box.number for b in page], return_inverse=True)[1]
    box_links = (np.bincount(box, linked) / np.bincount(box, words))[box]
    flags = np.array([(b.heading, b.box.aside, b.box.named, b.box.hinted, b.box.article) for b in page], float).reshape(-1, 5)
    inside = np.array([b.box.article and not b.box.aside and not b.box.named for b in page])
    rights = np.array(["\u00a9" in b.text or "all rights reserved" in b.text.lower() for b in page], float)
    share = np.full(len(page), words[inside].sum() / words.sum())
    return np.column_stack([w[1:-1], d[1:-1], w[:-2], d[:-2], w[2:], d[2:], box_links, flags, share, rights])


# The labelled table and the tree ----------------------------------------------------------------------------------------


def labelled(pages: int = 600, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main text) of the blocks of pages made by rule.

    Half of the pages have no article. What is not content has from 3 to 200 words; it is told by its tag, by its names, by its links
    or by lying outside of the article, and content has names that sound like it.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeiourstnlm", k=rng.randint(2, 9)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    link = lambda a, b: f'<a href="/{word()}">{say(a, b)}</a>'
    long = lambda: say(*rng.choice([(3, 12), (10, 40), (30, 90), (80, 200)]))
    chance = lambda p: rng.random() < p
    box = lambda keep, inner, tag="div", more="": f'<{tag} data-keep="{keep}"{more}>{inner}</{tag}>'
    name = lambda words: f' {rng.choice(["class", "id"])}="{rng.choice(words.split())}"'

    def bare() -> str:
        """Links and nothing else, one beside another or one below another."""
        n = rng.randint(1, 9)
        return rng.choice([lambda: "<ul>" + "".join(f"<li>{link(1, 6)}</li>" for _ in range(n + 1)) + "</ul>", lambda: " ".join(link(1, 3) for _ in range(n)), lambda: "".join(f"<div>{link(1, 5)}</div>" for _ in range(n))])()

    def paragraph() -> str:
        out = say(*rng.choice([(1, 4), (4, 15), (15, 60), (30, 120), (60, 200)]))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 3])):
            out += f" {link(1, 4)} {say(4, 20)}"
        return f"<p>{out}</p>"

    def story(framed: bool) -> str:
        out = f"<h1>{say(1, 9)}</h1>" if chance(0.7) else ""
        for i in range(rng.choice([1, 1, 2, 4, 8])):
            out += f"<h2>{say(1, 5)}</h2>" if chance(0.2) else ""
            out += f"<p>{say(20, 90)}</p>" if i == 0 and not framed else paragraph()
            if chance(0.1):
                out += "<ul>" + "".join(f"<li>{say(2, 15)}{' ' + link(1, 2) if chance(0.2) else ''}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
            if chance(0.1):
                out += f"<p>{say(2, 6)} {link(1, 3)}</p><p>{say(20, 60)}</p>"
            if chance(0.1) and framed:
                out += rng.choice([f"<p>{say(3, 20)} &copy; {say(3, 20)}</p>", "<p>All rights reserved.</p>"])
            if chance(0.25):
                out += box(1, (f"<h2>{say(1, 3)}</h2>" if chance(0.5) else "") + "".join(f"<p>{say(5, 90)}</p>" for _ in range(rng.randint(1, 3))), rng.choice(["div", "section"]), name("related-work share-price header-files comment-analysis search-results-study alert-levels"))
        return out

    x, y = [], []
    for i in range(pages):
        framed = i % 2 == 0  # the page has an article
        marked = i % 4 < 3  # and says what is not content

        def out(words: str, tag: str, inner: str, i: int = i, framed: bool = framed, marked: bool = marked) -> str:
            """What is not content, in a tag of its own, or under a name, or, where the page can tell by other means, without either."""
            if framed and chance(0.3) or not marked:
                return box(0, inner)
            return box(0, inner, tag) if chance(0.5) else box(0, inner, rng.choice(["div", "section"]), name(words))

        aside = lambda: out("sidebar related widget recommended popular trending-posts", "aside", (f"<h3>{say(1, 3)}</h3>" if chance(0.6) else "") + (bare() if not marked or chance(0.6) else f"<p>{long()}</p>"))  # noqa: E731, B023
        notice = lambda: box(0, f"<p>{long()}</p>" + (f"<p>{link(1, 3)}</p>" if chance(0.4) else ""), "div", name("cookie-notice cookies consent-banner privacy-notice newsletter alert popup")) if marked else ""  # noqa: E731, B023
        ad = lambda: box(0, f"<p>{long()}</p>" if chance(0.5) else say(3, 14), "div", name("ad ads advert sponsored promo-box")) if marked else ""  # noqa: E731, B023
        said = lambda: "".join(rng.choice([f"<p>{long()}</p>", f"<div><p>{link(1, 2)} {say(0, 3)}</p><p>{long()}</p></div>"]) for _ in range(rng.randint(1, 5)))
        comments = lambda: box(0, (f"<h3>{say(1, 3)}</h3>" if chance(0.4) else "") + said(), rng.choice(["div", "section"]), name("comments user-feedback reader-comments discussion replies") if marked else "") if marked or framed else ""  # noqa: E731, B023
        foot = lambda: box(0, f"<p>&copy; {say(2, 12)} {link(1, 2) if chance(0.5) else ''}</p>") if not marked and not framed else out("footer site-footer colophon", "footer", rng.choice([f"<p>{long()}</p>", f"<p>&copy; {say(2, 20)}</p>{bare()}"]))  # noqa: E731, B023
        form = lambda: box(0, f"<p>{say(1, 20)}</p><button>{say(1, 2)}</button>", "form")
        head = lambda: out("header masthead topbar", "header", rng.choice([f"{link(1, 4)} {say(0, 4)}", bare()]) if not marked else f"<p>{long()}</p>" if chance(0.4) else bare())  # noqa: E731, B023
        menu = lambda: out("menu nav navigation", "nav", bare())
        inner = story(framed)
        if framed or marked:  # within the article
            inner += ad() if chance(0.2) else ""
            inner += comments() if chance(0.2) else ""
            inner += aside() if chance(0.15) and marked else ""
        if chance(0.25):
            inner += box(0, (f"<h3>{say(1, 2)}</h3>" if chance(0.3) else "") + "<ul>" + "".join(f"<li>{link(1, 8)}</li>" for _ in range(rng.randint(2, 7))) + "</ul>")
        main = box(1, inner, rng.choice(["article", "main"])) if framed else box(1, inner, "div", rng.choice(["", "", ' class="content"', ' id="text"']))
        some = lambda *parts: (lambda much: "".join(f() for f in parts if chance(much)))(rng.choice([0, 0.3, 0.7]))
        own = blocks(some(menu, head, notice, ad, form) + main + some(aside, comments, form, notice, menu, foot))
        x.append(features(own))
        y += [b.box.label for b in own]
    return np.concatenate(x), np.array(y)


Tree = tuple | bool


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """A CART: (feature, threshold, tree at or below, tree above), or whether a block is kept."""
    if depth == 0 or y.min() == y.max() or len(y) < 4:
        return bool(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for v in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= v
            a, b, p, q = low.sum(), (~low).sum(), y[low].mean(), y[~low].mean()
            cost = a * p * (1 - p) + b * q * (1 - q)
            if best is None or cost < best[0] - 1e-9:
                best = (cost, f, float(v), low)
    if best is None:
        return bool(y.mean() >= 0.5)
    _, f, v, low = best
    return (f, v, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def kept(tree: Tree, row: np.ndarray) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree: Tree) -> str:
    own = blocks(page)
    return " ".join(b.text for b, row in zip(own, features(own), strict=True) if kept(tree, row)) if own else ""


ROWS = "page_id long, url string, text string, n_chars long"


def _extracted(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for b in by_rows(batches, text_sizes("html"), 4 << 20):
        text = [main_text(t, tree) for t in texts_of(b, "html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    tree = tree if tree is not None else grow(*labelled())
    return pages.select("page_id", "url", "html").mapInArrow(lambda it: _extracted(it, tree), ROWS)
