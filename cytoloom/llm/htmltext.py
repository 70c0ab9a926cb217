"""Main text of web pages by gradient-boosted trees over DOM nodes.

A tolerant parser makes a tree of blocks. Every node has features of its own
subtree, of its attribute tokens, its depth and its siblings; boosted trees
give the probability that it holds main text; and decoding picks the most
likely labelling in which no node is main text below one that is not. The
trees are trained here, on pages that ``sample_pages`` writes with the truth
known: many layouts, with and without telling tags and class names.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_lists

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
SILENT = frozenset("script style noscript template iframe svg head title textarea select option button canvas object audio video math datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split()
)
#: A start tag that ends an open element, and what that search does not go beyond.
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Attribute tokens that tell content or boilerplate.
GOOD = frozenset("article content main post entry story body text page blog hentry prose markdown read reader column".split())
BAD = frozenset(
    "nav menu header footer sidebar aside ad ads advert advertisement sponsor sponsored promo banner cookie consent notice gdpr popup modal overlay comment comments disqus reply respond share social related recommended widget breadcrumb breadcrumbs pagination pager toolbar subscribe newsletter signup login search form copyright legal disclaimer masthead topbar tags links rail teaser meta byline alert".split()
)
TAGS = ("p", "div", "section", "article", "main", "body", "html", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "#text")

#: Where the search for an open p stops.
HOLDS_P = ("td", "th", "table", "button", "object", "caption")

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPLIT = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kids", "parent", "parts", "tokens", "silent", "inline", "links", "stats")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset = frozenset(), inline: bool = False):
        self.tag, self.parent, self.tokens, self.inline = tag, parent, tokens, inline
        self.kids: list[Node] = []
        self.parts: list[str] = []  # of #text
        self.links = 0  # characters in links, of #text
        self.silent = tag in SILENT or (parent is not None and parent.silent)
        self.stats = None


def tokens_of(attributes: str) -> frozenset:
    found = set()
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
                found.add("#hidden")
            elif name != "style":
                found.update(SPLIT.findall(value))
    return frozenset(found)


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Index behind the tag whose attributes start at ``at``. Quotes count behind an equals sign; one that nothing closes does not.

    ``last``: the last place of either quote in the page, so that no search for a closing one fails at length.
    """
    while m := STOP.search(page, at):
        k = m.start()
        if page[k] == ">":
            return k + 1
        before = k - 1
        while page[before].isspace():
            before -= 1
        at = page.index(page[k], k + 1) + 1 if page[before] == "=" and k < last[page[k]] else k + 1
    return len(page)


class Open:
    """The open elements, with the places of each tag and of blocks among them, so that no search walks through all."""

    def __init__(self, root: Node):
        self.stack, self.blocks, self.links = [root], [0], 0
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if not node.inline:
            self.blocks.append(len(self.stack))
        self.links += node.tag == "a"
        self.stack.append(node)

    def nearest(self, tags) -> int:
        """Place of the innermost element of one of the tags, 0 if there is none."""
        return max((found[-1] for t in tags if (found := self.places.get(t))), default=0)

    def close(self, k: int) -> None:
        """Ends the element at place ``k`` and all within."""
        while len(self.stack) > k:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if not node.inline:
                self.blocks.pop()
            self.links -= node.tag == "a"

    @property
    def block(self) -> Node:
        return self.stack[self.blocks[-1]]


def parse(page: str) -> Node:
    """Tree of block elements; text, inline elements' included, in #text leaves below the blocks. Linear in the page."""
    root = Node("#root", None)
    open_ = Open(root)
    last = {quote: page.rfind(quote) for quote in "\"'"}
    done, pos, n = 0, 0, len(page)

    def text(piece: str) -> None:
        at = open_.block
        if not piece or at.silent or open_.stack[-1].silent:
            return
        leaf = at.kids[-1] if at.kids and at.kids[-1].tag == "#text" else None
        if leaf is None:
            if piece.isspace():
                return
            leaf = Node("#text", at)
            at.kids.append(leaf)
        piece = entities.unescape(piece)
        leaf.parts.append(piece)
        if open_.links:
            leaf.links += len(piece)

    while (start := page.find("<", pos)) >= 0:
        mark = page[start + 1 : start + 2]
        m = NAME.match(page, start + 1)
        if m is None and mark not in ("!", "?"):
            pos = start + 1  # a lone < is text
            continue
        text(page[done:start])
        if m is None:
            ends = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(ends, start + 2)
            done = pos = n if end < 0 else end + len(ends)
            continue
        done = pos = tag_end(page, m.end(), last)
        tag, given = m[2].lower(), page[m.end() : pos].removesuffix(">")
        if m[1]:
            k = open_.nearest((tag,))
            if k and (tag in BLOCK or open_.blocks[-1] <= k):  # an inline end tag does not end a block
                open_.close(k)
            continue
        if tag in ENDS_P and (k := open_.nearest(("p",))) > open_.nearest(HOLDS_P):
            open_.close(k)
        if tag in ENDS:
            ended, beyond = ENDS[tag]
            if (k := open_.nearest(ended)) > open_.nearest(beyond):
                open_.close(k)
        at = open_.block
        if tag in VOID:
            text(" " if tag in ("br", "wbr", "hr", "img") else "")
            if tag == "hr":
                at.kids.append(Node("hr", at))
            continue
        inline = tag not in BLOCK and tag not in SILENT
        node = Node(tag, at, frozenset() if inline else tokens_of(given), inline)
        if not inline:
            at.kids.append(node)
        open_.push(node)
        if tag in RAW and not given.rstrip().endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
            done = pos = stop.start() if stop else n
    text(page[done:])
    return root


def body_text(leaf: Node) -> str:
    return SPACE.sub(" ", "".join(leaf.parts)).strip()


def flatten(root: Node) -> list[Node]:
    """Nodes that hold text, parents before their children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.silent:
            continue
        out.append(node)
        stack.extend(reversed(node.kids))
    return out


BOILER, PROSE = frozenset(["nav", "header", "footer", "aside", "form"]), frozenset(["article", "main"])
PLACE = {t: k for k, t in enumerate(TAGS)}
ONE = np.vstack([np.eye(len(TAGS)), np.zeros(len(TAGS))])


def measure(trees: list[list[Node]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the nodes of all trees, and the row of each one's parent (-1 for roots)."""
    facts, parents, tags, starts = [], [], [], []
    for nodes in trees:
        first = len(facts)
        index: dict[int, int] = {}
        before = 0
        for n in nodes:
            k = len(facts)
            index[id(n)] = k
            up = index.get(id(n.parent), -1) if k > first else -1
            good, bad = len(n.tokens & GOOD), len(n.tokens & BAD) + 2 * ("#hidden" in n.tokens)
            # characters, link characters, words, sentence ends, leaves, blocks | depth, place, children, good, bad, above, in prose, in boilerplate, in good, in bad, characters up to here, root
            if n.tag == "#text":
                t = "".join(n.parts)
                before += len(t)
                fact = [len(t), n.links, t.count(" ") + 1, t.count(". ") + t.count("? ") + t.count("! ") + t.rstrip().endswith((".", "!", "?")), 1, 0]
            else:
                fact = [0, 0, 0, 0, 0, 1]
            if up < 0:
                fact += [0, 0, 0, good, bad, 0, n.tag in PROSE, n.tag in BOILER, good > 0, bad > 0, before, first]
            else:
                p = facts[up]
                p[8] += 1
                fact += [p[6] + 1, p[8], 0, good, bad, p[11] + p[10] - 0.5 * p[9], p[12] or n.tag in PROSE, p[13] or n.tag in BOILER, p[14] or good > 0, p[15] or bad > 0, before, first]
            facts.append(fact)
            parents.append(up)
            tags.append(PLACE.get(n.tag, len(TAGS)))
        for k in range(len(facts) - 1, first, -1):
            own, p = facts[k], facts[parents[k]]
            for j in range(6):
                p[j] += own[j]
        starts.append(first)
    f, parent, tag = np.array(facts, float).reshape(-1, 18), np.array(parents, int), np.array(tags, int)
    up = np.where(parent < 0, np.arange(len(parent)), parent)
    chars, links, words, ends, leaves, blocks, depth, place, kids, good, bad, above, a, b, c, d, seen, root = f.T
    whole = np.maximum(chars[root.astype(int)], 1)
    over = np.maximum(chars[up], 1)
    x = np.c_[
        np.log1p(chars), np.log1p(words), chars / np.maximum(blocks, 1) / 100, links / np.maximum(chars, 1), ends / np.maximum(words, 1) * 10, ends, leaves, blocks,
        chars / whole, chars / over, np.log1p(np.maximum(chars[up] - chars, 0)), links[up] / over, depth, place, place / np.maximum(kids[up], 1), kids[up], kids,
        good, bad, above, a, b, c, d, seen / whole, ONE[tag], ONE[np.where(parent < 0, len(TAGS), tag[up])],
    ]
    return x, parent


class Boosted:
    """Gradient-boosted regression trees of depth 3 for the log-loss, grown on quantile bins."""

    DEPTH = 3

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, rate: float = 0.3, bins: int = 24):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self.bin(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), self.base)
        inner = (1 << self.DEPTH) - 1
        self.trees = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            feature, cut, at = np.zeros(inner, int), np.full(inner, bins + 1), np.zeros(len(y), int)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                if len(rows) > 20:
                    feature[node], cut[node] = self.split(b[rows], g[rows], h[rows], bins)
                at[rows] = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            leaf = at - inner
            value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            margin += value[leaf]
            self.trees.append((feature, cut, value))

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], axis=1).astype(np.int16)

    @staticmethod
    def split(b: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> tuple[int, int]:
        best, found = 1e-6, (0, bins + 1)
        gs, hs = g.sum(), h.sum()
        for f in range(b.shape[1]):
            gl = np.cumsum(np.bincount(b[:, f], g, bins + 1))[:-1]
            hl = np.cumsum(np.bincount(b[:, f], h, bins + 1))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (f, k)
        return found

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self.bin(x)
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.DEPTH):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            margin += value[at - len(feature)]
        return 1 / (1 + np.exp(-margin))


def decode(p: np.ndarray, parent: np.ndarray) -> list[bool]:
    """The likeliest labels of the nodes such that whatever is below a 0 is 0; parents come first, -1 marks roots."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    some, none, up = np.log(p).tolist(), np.log(1 - p).tolist(), parent.tolist()
    for k in range(len(up) - 1, -1, -1):
        if up[k] >= 0:
            none[up[k]] += none[k]  # of the whole subtree
            some[up[k]] += max(some[k], none[k])
    label = []
    for k, above in enumerate(up):
        label.append(some[k] > none[k] and (above < 0 or label[above]))
    return label


def extract_all(pages: list[str], model: Boosted) -> list[str]:
    """Main texts, blocks joined by line ends."""
    trees = [flatten(parse(p)) for p in pages]
    if not trees:
        return []
    x, parent = measure(trees)
    label = iter(decode(model.probability(x), parent))
    out = []
    for nodes in trees:
        blocks = [body_text(n) for n, keep in zip(nodes, label) if keep and n.tag == "#text"]
        out.append("\n".join(b for b in blocks if b))
    return out


def sample_pages(n: int, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Pages of many layouts and the texts of their main blocks, which no other block has."""
    r = random.Random(seed)
    stock = ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouéü") for _ in range(r.randint(1, 4))) for _ in range(2_000)]

    def words(a: int, b: int) -> str:
        return " ".join(r.choices(stock, k=r.randint(a, b)))

    def sentence() -> str:
        return words(1, 18).capitalize() + r.choice([".", ".", ".", "?", "!"])

    def prose(a: int = 1, b: int = 8) -> str:
        return " ".join(sentence() for _ in range(r.randint(a, b)))

    def named(tag: str, *names: str) -> str:
        kind = r.random()
        if not names or kind < 0.25:
            return f"<{tag}>"
        return f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", "-wrap", " box", "-1", ""])}">'

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.choices(stock, k=k))

    def boilerplate(where: str) -> str:
        kind = r.choice({"top": ["nav", "nav", "header", "ad", "cookie", "crumb", "search"], "side": ["aside", "ad", "related", "form", "list"], "end": ["footer", "footer", "comments", "share", "form", "ad", "cookie", "related"], "in": ["ad", "share", "form", "related"]}[where])
        if kind == "nav":
            tag, names = r.choice([("nav", ("main-nav", "")), ("div", ("menu", "nav", "navbar")), ("ul", ("menu", "nav"))])
            inner = links(r.randint(2, 9))
            return named(tag, *filter(None, names)) + (inner if tag == "ul" else f"<ul>{inner}</ul>") + f"</{tag}>"
        if kind == "header":
            tag = r.choice(["header", "div"])
            start = named(tag, "masthead", "site-header", "topbar") if tag == "div" else "<header>"
            own = r.choice(["p", "div", "h2"])
            return start + f"<{own}>{words(1, 6)}</{own}>" * (r.random() < 0.3) + f"<a href='/'>{words(1, 3)}</a><p>{words(2, 8)}</p></{tag}>"
        if kind == "ad":
            return f'<div class="{r.choice(["ad", "ads", "advert", "sponsored", "promo banner", "ad-slot"])}">{r.choice([prose(1, 2), f"<p>{prose(1, 2)}</p>", f"<a href=#>{words(2, 8)}</a>"])}</div>'
        if kind == "cookie":
            return f'<div {r.choice(["class", "id"])}="{r.choice(["cookie", "cookie-notice", "consent", "gdpr notice", "alert banner"])}"><p>{prose(1, 2)}</p><button>{words(1, 2)}</button></div>'
        if kind == "crumb":
            return f'<div class="breadcrumbs">{" / ".join(f"<a href=#>{w}</a>" for w in r.choices(stock, k=3))}</div>'
        if kind == "search":
            return f'<form action="/s"><label>{words(1, 3)}</label><input name=q><button>{words(1, 1)}</button></form>'
        if kind == "aside":
            tag = r.choice(["aside", "div"])
            start = "<aside>" if tag == "aside" else f'<div class="{r.choice(["sidebar", "widget", "rail", "side-bar aside"])}">'
            return start + f"<h3>{words(1, 4)}</h3>" + r.choice([f"<ul>{links(5)}</ul>", f"<p>{prose(1, 3)}</p>"]) + f"</{tag}>"
        if kind == "related":
            return named("div", "related", "recommended", "links") + f"<h3>{words(1, 3)}</h3><ul>" + "".join(f"<li><a href=#>{words(3, 9)}</a></li>" for _ in range(r.randint(2, 6))) + "</ul></div>"
        if kind == "list":
            return f"<ul>{links(r.randint(3, 8))}</ul>"
        if kind == "form":
            return r.choice(["<form>", '<form class="newsletter">']) + f"<p>{prose(1, 1)}</p><input><button>{words(1, 2)}</button></form>"
        if kind == "share":
            return named("div", "share", "social", "tags") + "".join(f"<a href=#>{words(1, 2)}</a> " for _ in range(r.randint(2, 5))) + "</div>"
        if kind == "comments":
            tag = r.choice(["div", "section", "ol"])
            item = "li" if tag == "ol" else "div"
            return f'<{tag} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "disqus", "reader-comments"])}"><h3>{words(1, 3)}</h3>' + "".join(f'<{item} class="comment"><b>{words(1, 2)}</b><p>{prose(1, 4)}</p></{item}>' for _ in range(r.randint(1, 6))) + f"</{tag}>"
        tag = r.choice(["footer", "footer", "div"])
        start = "<footer>" if tag == "footer" else f'<div {r.choice(["class", "id"])}="{r.choice(["footer", "copyright", "site-footer", "legal"])}">'
        return start + r.choice([f"&copy; {words(1, 3)} &middot; {prose(1, 1)}", f"<p>&copy; {words(2, 5)}</p><ul>{links(4)}</ul>", f"<p>{prose(1, 2)}</p>"]) + f"</{tag}>"

    pages = []
    for _ in range(n):
        main: set[str] = set()

        def block(tag: str, text: str, close: bool = True, inner: str = "{}", main: set = main) -> str:
            main.add(SPACE.sub(" ", text).strip())
            return f"<{tag}>" + inner.format(text) + (f"</{tag}>" if close else "")

        title = words(2, 12).capitalize()
        body = []
        if r.random() < 0.8:
            body.append(block(r.choice(["h1", "h1", "h2"]), title))
        closes = r.random() < 0.8
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = r.random()
            text = prose(1, r.choice([1, 2, 8]))
            if kind < 0.7:
                body.append(block("p", text, closes, r.choice(["{}", "{}", "<b>{}<br>", "<i>{}</i>"])))
            elif kind < 0.76:
                body.append(block("h2", words(1, 7)))
            elif kind < 0.82:
                body.append("<ul>" + "".join(block("li", prose(1, 2)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                body.append(f"<blockquote>{block('p', text)}</blockquote>")
            elif kind < 0.89:
                body.append("<table>" + "".join(f"<tr>{block('td', words(1, 5))}{block('td', words(1, 5))}</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.93:
                body.append(block("div", text))
            else:
                body.append(boilerplate("in"))
        if r.random() < 0.6:
            r.shuffle(body[1:])
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        start = "<article>" if tag == "article" and r.random() < 0.7 else named(tag, "content", "post", "entry-content", "article-body", "story", "main")
        core = start + "".join(body) + f"</{tag}>"
        if r.random() < 0.3:
            core = named(r.choice(["div"]), "page", "container", "layout") + core + "".join(boilerplate("side") for _ in range(r.randint(0, 2))) + "</div>"
        elif r.random() < 0.3:
            core = boilerplate("side") + core
        top = "".join(boilerplate("top") for _ in range(r.choice([0, 1, 2, 2, 3])))
        low = "".join(boilerplate("end") for _ in range(r.choice([0, 1, 1, 2, 3])))
        pages.append((f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='<p>';</script></head><body>{top}{core}{low}" + r.choice(["</body></html>", "</body></html>", ""]), main))
    return pages


def truth(is_main: list[bool], parent: np.ndarray) -> np.ndarray:
    """1 for main text blocks and what they are in."""
    y = np.array(is_main, float)
    for k in range(len(y) - 1, -1, -1):
        if y[k] and parent[k] >= 0:
            y[parent[k]] = 1
    return y


@lru_cache(maxsize=2)
def trained(pages: int = 500, seed: int = 7) -> Boosted:
    """The model; the same wherever it is trained."""
    written = sample_pages(pages, seed)
    trees = [flatten(parse(page)) for page, _ in written]
    x, parent = measure(trees)
    is_main = [n.tag == "#text" and body_text(n) in main for nodes, (_, main) in zip(trees, written) for n in nodes]
    return Boosted(x, truth(is_main, parent))


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), model: Boosted | None = None) -> DataFrame:
    """page_id, the kept columns, text and n_chars (code points) of each page.

    Null or empty html gives an empty text, as does a page without main text.
    Null ids and repeated rows give a row each; other columns are not read; an
    empty table gives an empty result.
    """
    model = model or trained()

    def make():
        def step(*columns):
            texts = []
            for at in range(0, len(columns[-1]), 200):
                texts += extract_all([h or "" for h in columns[-1][at : at + 200]], model)
            return *columns[:-1], texts, list(map(len, texts))

        return step

    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("__html"))
    return map_lists(rows, make, f"page_id {kinds[id_col]}, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + "text string, n_chars long")
