"""A tolerant reader of HTML: elements with their generalised tag-class paths, and blocks of text; a small helper of the extraction."""

from __future__ import annotations

import functools
import html
import re

#: Markup of one kind after another: comments, tags (also one cut off at the end), declarations. Quotes guard ">" only as values of attributes.
_MARKUP = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TELLING = re.compile(r"\b(?:class|id|role|itemprop|hidden|aria-hidden|style)\b", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")

#: Text of these is no text of the page; their end is looked for as it stands.
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "textarea", "title", "svg", "math", "xmp", "canvas", "object", "audio", "video", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag of these ends an open paragraph.
ENDS_P = HEADINGS | {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements whose text is a block of its own; all others are inline.
BLOCKS = ENDS_P | {"html", "head", "body", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "legend", "summary", "hgroup", "search"}
#: Elements that can hold an article; text in others belongs to the nearest of these above.
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "center"}
#: A start tag ends an open element of these kinds, unless one of the fences is between.
_CELL, _TERM = ({"td", "th"}, {"tr", "table"}), ({"dt", "dd"}, {"dl"})
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": _TERM, "dd": _TERM, "tr": ({"tr"}, {"table"}), "td": _CELL, "th": _CELL, "body": ({"head"}, set())}

#: What isn't the article, by element, by role and by words of class or id: these go unless they hold an article or a first heading, ``ASIDE_WORDS`` whatever they hold.
SHELL_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "head", "search"}
SHELL_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
SHELL_WORDS = {
    "ad", "ads", "adbox", "adslot", "adsense", "adunit", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promoted", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar", "masthead", "header", "footer", "foot", "sidebar", "aside", "rail", "widget", "widgets", "copyright",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "disclaimer", "paywall", "popup", "modal", "overlay", "lightbox", "toast", "newsletter", "subscribe", "subscription", "signup", "login", "signin", "form", "search",
    "share", "sharing", "social", "skip", "hidden", "tooltip",
}
ASIDE_WORDS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion", "related", "recommended", "recommendations", "trending"}
#: "has-sidebar" is no sidebar.
LAYOUT_WORDS = {"has", "with", "no", "without", "is", "not"}
GOOD_WORDS = {"article", "content", "entry", "post", "story", "main", "body", "text"}


def general(name: str) -> str:
    """A class or id without what differs from page to page: runs of digits become #; names of several of them, or of nothing else, are left out."""
    found = re.sub(r"\d+", "#", name.lower())
    return "" if found.count("#") > 1 or found == "#" else found


def attributes(source: str) -> tuple[list[str], str, bool]:
    """Classes and ids, role, and whether the element is hidden."""
    names, role, hidden = [], "", False
    for key, a, b, c in _ATTRIBUTE.findall(source):
        key, value = key.lower(), html.unescape(a or b or c)
        if key in ("class", "id"):
            names += value.split()
        elif key == "role":
            role = value.strip().lower()
        elif key == "itemprop" and value == "articleBody":
            names.append("articleBody")
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    return names, role, hidden


@functools.lru_cache(8192)
def traits(tag: str, source: str) -> tuple[bool, bool, bool, str]:
    """Of an element with these attributes: is it never of the article, is it not of the article unless it holds one, is it named like one; its step of a path."""
    names, role, hidden = attributes(source)
    words = [{w.lower() for w in _PARTS.findall(n)} for n in names]
    telling = {w for name in words if not LAYOUT_WORDS & name for w in name} if tag not in ("html", "body") else set()
    aside = hidden or bool(telling & ASIDE_WORDS)
    shell = tag in SHELL_TAGS or role in SHELL_ROLES or bool(telling & SHELL_WORDS)
    good = tag == "article" or role == "main" or any(w & GOOD_WORDS for w in words)
    return aside, shell, good, tag + "".join("." + g for g in sorted({general(n) for n in names} - {""}))


class Element:
    """``shell``: not of the article, unless it ``holds`` one; ``aside``: never of it. ``path``: the generalised tags and classes from the body down."""

    __slots__ = ("tag", "parent", "step", "path", "shell", "aside", "good", "holds", "children", "blocks")

    def __init__(self, tag: str, parent: Element | None, source: str = ""):
        self.tag, self.parent, self.holds, self.children, self.blocks = tag, parent, False, [], []
        self.aside, self.shell, self.good, self.step = traits(tag, source)
        self.path = "" if parent is None or tag == "body" else f"{parent.path}>{self.step}" if parent.path else self.step

    def out(self) -> bool:
        return self.aside or (self.shell and not self.holds)


class Page:
    """The elements of a page and its ``blocks``: (element, text, characters in links), white space folded, none empty."""

    def __init__(self, source: str):
        self.root = Element("html", None)
        self.elements, self.blocks = [self.root], []
        self._open: list[Element] = [self.root]
        self._pieces: list[str] = []
        self._links, self._linked, self._mute = 0, 0, 0
        self._read(source)
        for element in self.elements:
            if element.tag in ("article", "main", "h1") and not any(e.aside for e in _up(element)):
                for above in _up(element.parent):
                    if above.holds or (element.tag == "h1" and above.tag in SHELL_TAGS and above.tag != "form"):
                        break
                    above.holds = True

    def _read(self, source: str) -> None:
        at = 0
        while m := _MARKUP.search(source, at):
            self._text(source[at : m.start()])
            at, tag = m.end(), (m[2] or "").lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not (m[3].endswith("/") and tag in ("svg", "math")):
                    end = _raw_end(tag).search(source, at)
                    at = end.start() if end else len(source)
            elif tag:
                self._start(tag, m[3])
        self._text(source[at:])
        self._block()

    def _text(self, text: str) -> None:
        if text and not self._mute:
            text = html.unescape(text) if "&" in text else text
            self._pieces.append(text)
            self._linked += len(text.strip()) if self._links else 0

    def _block(self) -> None:
        """End the block of text being read."""
        if self._pieces and (text := " ".join("".join(self._pieces).split())):
            owner = next(e for e in reversed(self._open) if e.tag in BLOCKS)
            owner.blocks.append(len(self.blocks))
            self.blocks.append((owner, text, self._linked))
        self._pieces, self._linked = [], 0

    def _start(self, tag: str, rest: str) -> None:
        if tag in BLOCKS:
            self._block()
            if tag in ENDS_P:
                self._close(self._depth({"p"}, {"td", "th", "li", "dd"} if tag != "p" else {"td", "th"}))
            if tag in ENDS:
                self._close(self._depth(*ENDS[tag]))
        elif tag == "br":
            self._pieces.append(" ")
        if tag in VOID or tag == "html" or (tag not in BLOCKS and rest.endswith("/")):
            return
        element = Element(tag, self._open[-1], rest if rest and _TELLING.search(rest) else "")
        self._open.append(element)
        if tag in BLOCKS:
            self.elements.append(element)
            element.parent.children.append(element)
        else:
            self._mute += element.shell or element.aside
            self._links += tag == "a"

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._pieces.append(" ")
            return
        depth = self._depth({tag}, set() if tag in BLOCKS else BLOCKS)
        if depth:
            if tag in BLOCKS:
                self._block()
            self._close(depth)

    def _depth(self, kinds: set[str], fences: set[str]) -> int | None:
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag in kinds:
                return i
            if self._open[i].tag in fences:
                return None
        return None

    def _close(self, depth: int | None) -> None:
        for e in self._open[depth:] if depth else ():
            if e.tag not in BLOCKS:
                self._mute -= e.shell or e.aside
                self._links -= e.tag == "a"
        if depth:
            del self._open[depth:]


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I)


def _up(element: Element | None):
    while element is not None:
        yield element
        element = element.parent
