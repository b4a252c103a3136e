"""Web pages as arrays of DOM nodes, and the features of nodes."""

from __future__ import annotations

import re
from html import unescape

import numpy as np

#: Elements by how they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes")
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure "
    "figcaption address header footer nav aside form fieldset details summary hgroup center hr video audio canvas dialog search menu legend".split()
)
#: An element of the key is closed by the start of one of these, up to the nearest of the second group.
CLOSES_P = BLOCK - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "li", "dt", "dd", "legend", "summary", "figcaption", "video", "audio", "canvas"} | {"li", "dt", "dd"}
ENDED_BY = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Inline elements left open end with the block around them.
SCOPES = frozenset("html body article section main div td th table ul ol dl blockquote figure header footer nav aside form fieldset details".split())

#: What attribute tokens say, by group; each group is a feature.
TOKENS = {
    "content": "article articlebody body content contents copy entry main maincontent post postcontent story text hentry column primary page wrapper container prose chapter abstract",
    "menu": "nav navbar navigation menu menubar topnav breadcrumb breadcrumbs pagination pager tabs toc sitemap skip dropdown links",
    "head": "header head masthead topbar banner logo branding hero toolbar",
    "foot": "footer foot colophon copyright legal bottom credits",
    "side": "sidebar side aside widget widgets rail secondary related recommended recommendations popular trending more latest tags tagcloud archive",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall signup disclaimer toast message banner-notice",
    "ad": "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promoted promotion dfp gpt outbrain taboola",
    "form": "form search searchbox login signin register contact input field captcha",
    "talk": "comment comments commentlist discussion disqus reply replies respond responses reviews feedback reader forum",
    "share": "share sharing social socials follow twitter facebook like likes buttons button meta byline author date print rating vote",
}
GROUPS = list(TOKENS)
_GROUP_OF = {t: i for i, g in enumerate(GROUPS) for t in TOKENS[g].split()}
TAGS = ("html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "a", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "span", "b", "button", "label")
_TAG_OF = {t: i for i, t in enumerate(TAGS)}
_HEAVY = {"nav": 1, "header": 2, "footer": 3, "aside": 4, "form": 5, "article": 6, "main": 7, "button": 8, "label": 8, "dialog": 9, "figure": 10, "menu": 1}

_ATTRS = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})(?=[\s/>])({_ATTRS})(?<!/)>(?:.*?</\1\s*>|.*\Z)|<(/?)([a-zA-Z][^\s/<>]*)({_ATTRS}|[^<>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""\shidden(?:[\s=>]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPACE = re.compile(r"\s+")


class Page:
    """Nodes in page order: tag, parent, attribute groups (bits); and pieces of text: node, text, number of the block run.

    Each start or end of a block element begins another run; pieces of one run are one block's text.
    """

    __slots__ = ("tags", "parents", "groups", "hidden", "text_of", "texts", "runs")

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.groups, self.hidden = ["#root"], [-1], [0], [False]
        self.text_of: list[int] = []
        self.texts: list[str] = []
        self.runs: list[int] = []
        stack, tags, at, run = [0], self.tags, 0, 0
        for m in _TOKEN.finditer(html):
            a, z = m.span()
            if a > at:
                self.text_of.append(stack[-1])
                self.texts.append(html[at:a])
                self.runs.append(run)
            at = z
            name = m[4]
            if name is None:
                continue
            name = name.lower()
            run += name in BLOCK
            if m[3]:
                if name == "p" and not any(tags[i] == "p" for i in stack):
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        del stack[k:]
                        break
                    if tags[stack[k]] in SCOPES and name not in BLOCK:
                        break
                continue
            if name in BLOCK or name in ENDED_BY:
                self._close_for(name, stack)
            elif name == "br":
                self.text_of.append(stack[-1])
                self.texts.append(" ")
                self.runs.append(run)
            node = len(tags)
            tags.append(name)
            self.parents.append(stack[-1])
            attrs = m[5]
            self.groups.append(_groups(attrs) if attrs else 0)
            self.hidden.append(bool(attrs and _HIDDEN.search(attrs)))
            if name not in VOID and not attrs.endswith("/"):
                stack.append(node)
        if at < len(html):
            self.text_of.append(stack[-1])
            self.texts.append(html[at:])
            self.runs.append(run)

    def _close_for(self, name: str, stack: list[int]) -> None:
        tags = self.tags
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                t = tags[stack[k]]
                if t == "p":
                    del stack[k:]
                    break
                if t in SCOPES or t in ("li", "button"):
                    break
        ended = ENDED_BY.get(name)
        if ended:
            for k in range(len(stack) - 1, 0, -1):
                t = tags[stack[k]]
                if t in ended[1]:
                    break
                if t in ended[0]:
                    del stack[k:]
                    if name != "tr" or t == "tr":
                        break


def _groups(attrs: str) -> int:
    bits = 0
    for m in _NAMED.finditer(attrs):
        for word in _PARTS.findall(m[1] or m[2] or m[3] or ""):
            g = _GROUP_OF.get(word.lower())
            if g is not None:
                bits |= 1 << g
    return bits


def by_level(up: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth from the roots on, in order, so that a step over a level is one array operation. up: parents.

    Depths come from doubling the distance that is looked up, so very deep pages take little longer.
    """
    depth, over = (up >= 0).astype(np.int64), up
    while (over >= 0).any():
        at = np.maximum(over, 0)
        depth, over = depth + np.where(over >= 0, depth[at], 0), np.where(over >= 0, over[at], -1)
    return np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if len(up) else []


FEATURES = len(TAGS) + 1 + 2 * len(GROUPS) + 24


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of all pages, their parents as numbers in the batch (-1: root), and each page's first node."""
    sizes = np.fromiter((len(p.tags) for p in pages), np.int64, len(pages))
    base = np.append(0, np.cumsum(sizes))
    n = int(base[-1])
    shift = np.repeat(base[:-1], sizes)
    parent = np.array([x for p in pages for x in p.parents], np.int64)
    up = np.where(parent < 0, -1, parent + shift)
    tags = [t for p in pages for t in p.tags]
    tag = np.fromiter((_TAG_OF.get(t, len(TAGS)) for t in tags), np.int64, n)
    heavy = np.fromiter((_HEAVY.get(t, 0) for t in tags), np.int64, n)
    group = np.array([x for p in pages for x in p.groups], np.int64)
    bits = (group[:, None] >> np.arange(len(GROUPS)) & 1).astype(np.float32)
    page = np.repeat(np.arange(len(pages)), sizes)
    owner = np.array([x for p in pages for x in p.text_of], np.int64) + np.repeat(base[:-1], [len(p.text_of) for p in pages])
    texts = [t for p in pages for t in p.texts]
    owner = owner.astype(np.int64)
    chars = np.bincount(owner, [len(t.strip()) for t in texts], n)
    words = np.bincount(owner, [t.count(" ") + 1 if not t.isspace() else 0 for t in texts], n)
    stops = np.bincount(owner, [t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in texts], n)
    depth = np.zeros(n)
    order = np.arange(n)
    inherited = bits.copy()
    under = np.zeros((n, 11), bool)
    under[order, heavy] = heavy > 0
    below = {"chars": chars.copy(), "words": words.copy(), "stops": stops.copy(), "nodes": np.ones(n), "links": np.where(tag == _TAG_OF["a"], chars, 0.0), "anchors": (tag == _TAG_OF["a"]).astype(float), "paras": (tag == _TAG_OF["p"]).astype(float)}
    levels = by_level(up)
    in_link = tag == _TAG_OF["a"]
    for rows in levels[1:]:
        depth[rows] = depth[up[rows]] + 1
        inherited[rows] = np.maximum(inherited[rows], inherited[up[rows]])
        under[rows] |= under[up[rows]]
        in_link[rows] |= in_link[up[rows]]
    below["links"] = np.where(in_link, chars, 0.0)
    for rows in levels[:0:-1]:
        for v in below.values():
            np.add.at(v, up[rows], v[rows])
    siblings = np.bincount(up[up >= 0], minlength=n)
    of_parent = np.where(up >= 0, siblings[np.maximum(up, 0)], 1)
    key = np.where(up >= 0, up * (len(TAGS) + 1) + tag, -1 - order)
    _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
    alike = counts[which]
    total = below["chars"][base[:-1]][page]
    nodes = np.maximum(below["nodes"], 1)
    size = np.maximum(below["chars"], 1)
    parent_chars = np.where(up >= 0, below["chars"][np.maximum(up, 0)], total)
    place = (order - shift) / np.maximum(sizes[page], 1)
    rest = np.stack(
        [
            depth,
            np.log1p(chars),
            np.log1p(below["chars"]),
            below["chars"] / nodes,
            below["links"] / size,
            np.log1p(below["anchors"]),
            np.log1p(below["paras"]),
            below["stops"] / np.maximum(below["words"], 1),
            below["chars"] / np.maximum(below["words"], 1),
            below["chars"] / np.maximum(total, 1),
            below["chars"] / np.maximum(parent_chars, 1),
            np.log1p(below["nodes"]),
            of_parent,
            alike,
            alike / np.maximum(of_parent, 1),
            place,
            *(under[:, k] for k in (1, 2, 3, 4, 5, 6, 7, 8)),
        ],
        1,
    ).astype(np.float32)
    one = np.zeros((n, len(TAGS) + 1), np.float32)
    one[order, tag] = 1
    return np.concatenate([one, bits, inherited, rest], 1), up, base


def blocks(page: Page, kept: np.ndarray) -> str:
    """The text of the kept nodes: white space in a block is one space, blocks are joined by a line feed."""
    out: list[str] = []
    parts: list[str] = []
    last = -1
    for node, text, run in zip(page.text_of, page.texts, page.runs, strict=True):
        if run != last and parts:
            out.append(_SPACE.sub(" ", "".join(parts)).strip())
            parts = []
        last = run
        if kept[node]:
            parts.append(unescape(text))
    if parts:
        out.append(_SPACE.sub(" ", "".join(parts)).strip())
    return "\n".join(x for x in out if x)
