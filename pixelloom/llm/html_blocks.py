"""Leaf blocks of an HTML page: runs of text between the bounds of block elements.

The reader takes tags as they come, closes what HTML closes by itself (paragraphs, list items, table
cells), lets an end tag close all that stands open inside its element, and ignores end tags without
one. It never fails, and its time is linear in the page.
"""

from __future__ import annotations

import re
from html import unescape

# fixed values: element kinds of the HTML standard
BLOCKS = frozenset("""html body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead
    tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend address details summary dialog hr center menu
    search hgroup""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param frame".split())
#: Their content is text up to the end tag, and none of it is shown as text of the page.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Their content is no text of the page either.
DROPPED = frozenset("template noscript svg math object canvas audio video select button datalist map".split())
SPACED = frozenset(("br", "img", "input", "wbr"))
#: What a start tag closes, and the element that bounds the search for it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}

_BARE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)\s*/?>")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/][^\s=>/]*)(?:\s*=\s*)?")
_VALUE = re.compile(r"[^\s>]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An open element: its tag, the words of its names, and its parent."""

    __slots__ = ("tag", "words", "parent", "dropped", "cache")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None, dropped: bool):
        self.tag, self.words, self.parent, self.dropped = tag, words, parent, dropped
        self.cache = None  # for whoever reads the leaves


class Leaf:
    """A block's text with white space folded, how much of it is in links, and its element."""

    __slots__ = ("text", "linked", "node")

    def __init__(self, text: str, linked: int, node: Node):
        self.text, self.linked, self.node = text, linked, node


def name_words(value: str) -> tuple[str, ...]:
    """Lower-case words of a class, id or role: cut at other characters and at capitals."""
    return tuple(w.lower() for w in _WORD.findall(value))


class Reader:
    def __init__(self, html: str):
        self.html, self.leaves = html, []
        self.node = Node("", (), None, False)
        self.pieces: list[str] = []
        self.linked = 0
        self.in_link = False
        self.unclosed: set[str] = set()  # quotes that do not come again

    def read(self) -> list[Leaf]:
        html, at = self.html, 0
        while at < len(html):
            tag = html.find("<", at)
            if tag < 0:
                tag = len(html)
            if tag > at:
                self._text(html[at:tag])
            at = self._markup(tag) if tag < len(html) else tag
        self._flush()
        return self.leaves

    def _text(self, text: str) -> None:
        if not self.node.dropped:
            text = unescape(text) if "&" in text else text
            self.pieces.append(text)
            if self.in_link:
                self.linked += len(text)

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.leaves.append(Leaf(text, min(self.linked, len(text)), self.node))
            self.pieces, self.linked = [], 0

    def _past(self, mark: str, at: int) -> int:
        end = self.html.find(mark, at)
        return len(self.html) if end < 0 else end + len(mark)

    def _markup(self, at: int) -> int:
        """Read what begins with the ``<`` at ``at``; returns where it ends."""
        html = self.html
        bare = _BARE.match(html, at)
        if bare:
            name = bare.group(2).lower()
            if bare.group(1):
                self._end(name)
                return bare.end()
            return self._start(name, {}, bare.end())
        if html.startswith("<!--", at):
            return self._past("-->", at + 2 if html.startswith("<!-->", at) or html.startswith("<!--->", at) else at + 4)
        if html.startswith(("<!", "<?"), at):
            return self._past(">", at)
        closing = html.startswith("</", at)
        name = _NAME.match(html, at + 1 + closing)
        if not name:
            if closing:
                return self._past(">", at)
            self._text("<")
            return at + 1
        attributes, end = self._attributes(name.end())
        if closing:
            self._end(name.group().lower())
            return end
        return self._start(name.group().lower(), attributes, end)

    def _attributes(self, at: int) -> tuple[dict[str, str], int]:
        html, found = self.html, {}
        while True:
            name = _ATTRIBUTE.match(html, at)
            if not name:
                return found, self._past(">", at)
            at, value = name.end(), ""
            if html[at - 1] == "=" or "=" in html[name.end(1) : at]:
                quote = html[at : at + 1]
                end = html.find(quote, at + 1) if quote in ("'", '"') and quote not in self.unclosed else -1
                if end >= 0:
                    value, at = html[at + 1 : end], end + 1
                else:
                    if quote in ("'", '"'):
                        self.unclosed.add(quote)
                    bare = _VALUE.match(html, at)
                    value, at = bare.group(), bare.end()
            found.setdefault(name.group(1).lower(), value)

    def _start(self, tag: str, attributes: dict[str, str], at: int) -> int:
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(self.html, at)
            return end.end() if end else len(self.html)
        if tag in SPACED:
            self._text(" ")
        block = tag in BLOCKS or "-" in tag
        if block:
            self._flush()
            if self.node.tag == "p":
                self.node = self.node.parent
            self._close_implied(tag)
        if tag == "a":
            self.in_link = True
        if tag in VOID or tag == "html":
            return at
        hidden = "hidden" in attributes or _HIDDEN.search(attributes.get("style", "")) is not None
        dropped = tag in DROPPED or hidden
        if block or dropped:
            words = tuple(w for a in ("class", "id", "role") if a in attributes for w in name_words(unescape(attributes[a])))
            self.node = Node(tag, words, self.node, dropped or self.node.dropped)
        return at

    def _close_implied(self, tag: str) -> None:
        closed, bounds = CLOSES.get(tag, ((), ()))
        node, last = self.node, None
        while closed and node.tag and node.tag not in bounds:
            if node.tag in closed:
                last = node
            node = node.parent
        if last:
            self.node = last.parent

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        block = tag in BLOCKS or "-" in tag
        if block:
            self._flush()
        if not block and tag not in DROPPED and not self.node.dropped or tag in ("html", "body"):
            return
        node = self.node
        while node.tag and node.tag != tag:
            node = node.parent
        if node.tag:
            self._flush() if block else None
            self.node = node.parent


def read_blocks(html: str | None) -> list[Leaf]:
    """The leaf blocks of a page in their order; none for null."""
    return Reader(html).read() if html else []
