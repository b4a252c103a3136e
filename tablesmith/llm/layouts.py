"""Generated web pages with the role of every node known: training data of the HTML extraction."""

from __future__ import annotations

import numpy as np

SYLLABLES = "an ar be co da de el en er fa ge ha il in ka la le li ma mi na no ol or pa per qu ra re ri sa se si sta ta te ti to tu un va ve vi zu".split()


class Layout:
    """Builds one page; every start tag gets a label, in order: 1 if it is the article's or encloses it."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng, self.html, self.labels = rng, [], []

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def words(self, low: int, high: int, stops: bool = True) -> str:
        out = []
        for _ in range(int(self.rng.integers(low, high + 1))):
            word = "".join(SYLLABLES[i] for i in self.rng.integers(0, len(SYLLABLES), int(self.rng.integers(1, 5))))
            if stops and self.chance(0.12):
                word += self.pick(".", ",", ".", "?")
            out.append(word)
        text = " ".join(out).capitalize()
        return text + "." if stops else text

    def open(self, tag: str, keep: int, attrs: str = "") -> None:
        self.html.append(f"<{tag}{' ' + attrs if attrs else ''}>")
        self.labels.append(keep)

    def close(self, tag: str, sure: bool = True) -> None:
        if sure or self.chance(0.75):
            self.html.append(f"</{tag}>")

    def text(self, text: str) -> None:
        self.html.append(text)

    def leaf(self, tag: str, keep: int, text: str, attrs: str = "") -> None:
        self.open(tag, keep, attrs)
        self.text(text)
        self.close(tag)

    def named(self, *names: str) -> str:
        name = self.pick(*names)
        name = self.pick(name, name, f"{name}-{self.pick('box', 'area', 'block', 'inner', '1', 'x')}", f"{self.pick('site', 'page', 'js', 'l', 'c')}-{name}")
        return f'{self.pick("class", "class", "id")}="{name}"'

    def links(self, n: int, tag: str = "li") -> None:
        for _ in range(n):
            if tag:
                self.open(tag, 0)
            self.leaf("a", 0, self.words(1, 4, False), 'href="/x"')
            if tag:
                self.close(tag)

    def menu(self) -> None:
        tag = self.pick("nav", "nav", "div", "ul")
        self.open(tag, 0, self.named("menu", "navbar", "navigation", "topnav", "breadcrumbs", "tabs") if tag != "nav" or self.chance(0.4) else "")
        if tag != "ul" and self.chance(0.7):
            self.open("ul", 0)
            self.links(int(self.rng.integers(2, 12)))
            self.close("ul")
        else:
            self.links(int(self.rng.integers(2, 8)), "li" if tag == "ul" else "")
        self.close(tag)

    def head(self) -> None:
        tag = self.pick("header", "header", "div")
        self.open(tag, 0, self.named("header", "masthead", "topbar", "logo", "branding") if tag == "div" or self.chance(0.3) else "")
        self.leaf(self.pick("div", "h1", "a", "p"), 0, self.words(1, 5, False))
        if self.chance(0.5):
            self.leaf("p", 0, self.words(3, 12))
        if self.chance(0.4):
            self.menu()
        self.close(tag)

    def advert(self) -> None:
        tag = self.pick("div", "div", "section", "p", "aside", "span")
        self.open(tag, 0, self.named("ad", "ads", "advert", "sponsored", "promo", "adsense", "advertisement"))
        if tag in ("div", "section", "aside") and self.chance(0.4):
            self.leaf("p", 0, self.words(3, 30))
            if self.chance(0.5):
                self.leaf("a", 0, self.words(1, 3, False), 'href="/buy"')
        else:
            self.text(self.words(2, 25))
        self.close(tag)

    def notice(self) -> None:
        tag = self.pick("div", "div", "section", "dialog")
        self.open(tag, 0, self.pick(self.named("cookie", "consent", "notice", "newsletter", "popup", "modal", "gdpr", "alert"), 'role="alert"', self.named("cookie-notice", "cookie-banner")))
        if self.chance(0.6):
            self.leaf("p", 0, self.words(5, 40))
        else:
            self.text(self.words(5, 30))
        if self.chance(0.6):
            self.leaf("button", 0, self.words(1, 2, False))
        self.close(tag)

    def form(self) -> None:
        self.open("form", 0, self.named("search", "login", "signup", "contact") if self.chance(0.6) else "")
        if self.chance(0.5):
            self.leaf("p", 0, self.words(3, 20))
        for _ in range(int(self.rng.integers(1, 4))):
            self.leaf("label", 0, self.words(1, 3, False))
            self.open("input", 0, 'name="q"')
        self.leaf("button", 0, self.words(1, 2, False))
        self.close("form")

    def side(self) -> None:
        tag = self.pick("aside", "aside", "div", "section")
        self.open(tag, 0, self.named("sidebar", "side", "related", "widget", "recommended", "popular", "rail") if tag != "aside" or self.chance(0.4) else "")
        for _ in range(int(self.rng.integers(1, 4))):
            self.leaf(self.pick("h2", "h3", "h4", "p"), 0, self.words(1, 4, False))
            if self.chance(0.6):
                self.open("ul", 0)
                self.links(int(self.rng.integers(2, 7)))
                self.close("ul")
            else:
                for _ in range(int(self.rng.integers(1, 3))):
                    self.leaf("p", 0, self.words(4, 60))
        self.close(tag)

    def talk(self) -> None:
        tag = self.pick("div", "section", "div", "ul", "ol")
        self.open(tag, 0, self.named("comments", "comment-list", "discussion", "replies", "responses", "commentlist"))
        item = "li" if tag in ("ul", "ol") else self.pick("div", "article", "p")
        if item != "li" and self.chance(0.5):
            self.leaf("h3", 0, self.words(1, 3, False))
        for _ in range(int(self.rng.integers(1, 6))):
            self.open(item, 0, self.named("comment", "reply", "comment") if self.chance(0.75) else "")
            if item == "p":
                self.text(self.words(3, 60))
            else:
                if self.chance(0.5):
                    self.leaf(self.pick("span", "b", "h4", "div"), 0, self.words(1, 2, False), self.pick("", self.named("author")))
                for _ in range(int(self.rng.integers(1, 3))):
                    self.leaf("p", 0, self.words(3, 70))
                if self.chance(0.4):
                    self.leaf("a", 0, self.words(1, 1, False), 'href="#r"')
            self.close(item)
        if tag not in ("ul", "ol") and self.chance(0.4):
            self.form()
        self.close(tag)

    def share(self) -> None:
        self.open("div", 0, self.named("share", "social", "sharing"))
        self.links(int(self.rng.integers(2, 5)), self.pick("", "span"))
        self.close("div")

    def foot(self) -> None:
        tag = self.pick("footer", "footer", "div")
        self.open(tag, 0, self.named("footer", "foot", "copyright", "colophon") if tag == "div" or self.chance(0.3) else "")
        if self.chance(0.5):
            self.text("&copy; " + self.words(1, 20))
        for _ in range(int(self.rng.integers(0, 4))):
            self.leaf(self.pick("p", "div", "span"), 0, self.words(2, 40))
        if self.chance(0.5):
            self.menu()
        self.close(tag)

    def inline(self, low: int, high: int) -> None:
        self.text(self.words(low, high))
        for _ in range(int(self.rng.integers(0, 3)) if self.chance(0.4) else 0):
            self.leaf(self.pick("b", "a", "i", "em", "span", "strong", "code"), 1, self.words(1, 4, False))
            self.text(" " + self.words(1, max(2, high // 2)))
        if self.chance(0.1):
            self.open("br", 1)
            self.text(self.words(1, 12))

    def part(self) -> None:
        kind = self.rng.random()
        if kind < 0.62:
            tag = "p" if self.chance(0.93) else "div"
            self.open(tag, 1)
            if self.chance(0.15):
                self.open("b", 1)
                self.text(self.words(1, 90))
                self.open("br", 1)
                self.html.append(self.pick("", "</b>"))
                if self.html[-1]:
                    self.close(tag)
                elif tag == "div":
                    self.html.append("</b></div>")
            else:
                self.inline(1, self.pick(4, 20, 60, 120))
                self.close(tag, tag != "p")
        elif kind < 0.72:
            self.leaf(self.pick("h2", "h3", "h2", "h4"), 1, self.words(1, 9, False))
        elif kind < 0.82:
            tag = self.pick("ul", "ol")
            self.open(tag, 1)
            for _ in range(int(self.rng.integers(1, 7))):
                self.open("li", 1)
                self.inline(1, 25)
                self.close("li", False)
            self.close(tag)
        elif kind < 0.88:
            self.open("blockquote", 1)
            if self.chance(0.5):
                self.leaf("p", 1, self.words(3, 40))
            else:
                self.text(self.words(3, 40))
            self.close("blockquote")
        elif kind < 0.92:
            self.leaf("pre", 1, self.words(3, 30, False))
        elif kind < 0.96:
            self.open("figure", 1)
            self.open("img", 1, 'src="a.png"')
            self.leaf("figcaption", 1, self.words(2, 12))
            self.close("figure")
        else:
            self.open("table", 1)
            for _ in range(int(self.rng.integers(1, 4))):
                self.open("tr", 1)
                for _ in range(int(self.rng.integers(1, 4))):
                    self.leaf("td", 1, self.words(1, 5, False))
                self.close("tr")
            self.close("table")

    def article(self) -> None:
        tag = self.pick("article", "article", "main", "div", "div", "section")
        name = self.named("content", "post", "entry", "article", "story", "main", "text", "article-body", "postcontent")
        self.open(tag, 1, name if self.chance(0.75 if tag in ("div", "section") else 0.3) else "")
        inner = self.chance(0.25)
        if self.chance(0.85):
            self.leaf("h1", 1, self.words(1, 14, False))
        if self.chance(0.1):
            self.share()
        if inner:
            self.open("div", 1, self.pick("", self.named("body", "text", "prose", "entry")))
        for _ in range(int(self.rng.integers(1, self.pick(3, 8, 25)))):
            self.part()
            if self.chance(0.05):
                self.pick(self.advert, self.advert, self.share, self.notice, self.side, self.form)()
        if inner:
            self.close("div")
        if self.chance(0.12):
            self.pick(self.share, self.talk, self.foot, self.side)()
        self.close(tag)

    def page(self) -> tuple[str, list[int]]:
        self.html.append("<!DOCTYPE html>")
        self.open("html", 1)
        self.open("head", 0)
        self.open("meta", 0, 'charset="utf-8"')
        self.text(f"<title>{self.words(1, 8, False)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script>")
        self.close("head")
        self.open("body", 1)
        around = int(self.rng.integers(0, 3))
        for _ in range(around):
            self.open("div", 1, self.pick("", self.named("page", "wrapper", "container", "content", "main", "site"), f'class="{self.words(1, 1, False).lower()}"'))
        for _ in range(int(self.rng.integers(0, 5))):
            self.pick(self.menu, self.menu, self.head, self.head, self.advert, self.advert, self.notice, self.form, self.side)()
        self.article()
        for _ in range(int(self.rng.integers(0, 5))):
            self.pick(self.foot, self.foot, self.side, self.talk, self.talk, self.advert, self.share, self.form, self.notice, self.menu)()
        for _ in range(around):
            self.close("div")
        if self.chance(0.85):
            self.html.append("</body></html>")
        return "".join(self.html), self.labels


def generated(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page and the label of each of its start tags."""
    return Layout(rng).page()
