"""Leaf blocks of an HTML page: runs of text between block-level tags, each with the tags and classes above it.

An empty page has no blocks; a broken or very long one is read to its end. Blocks come in page order, so there are no ties.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Tags that end a run of text.
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements whose content is no text of the page. What stands in for other media, and formulas, are text.
HIDDEN = {"script", "style", "template", "title", "head", "svg", "iframe", "select", "textarea"}
#: What may stand in a head; any other start tag, and text, ends it.
HEAD = {"base", "link", "meta", "noframes", "noscript", "script", "style", "template", "title", "head"}
#: Elements whose text stands in for something else; each is a block of its own.
FALLBACK = {"noscript", "object", "button", "canvas", "audio", "video"}
#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What a start tag ends, looking up to the nearest container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}
_WORD = re.compile(r"[A-Za-z]+")
_WHITE = re.compile(r"\s+")


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, list[str], int]] = []
        self.stack: list[tuple[str, list[str]]] = []
        self.run: list[str] = []
        self.linked = self.links = 0
        self.hidden: list[str] = []  # a hidden element and what is open in it
        self.headed = False

    def set_cdata_mode(self, elem, **options):
        # Else an unclosed iframe or textarea would take the rest of the page.
        if elem in ("script", "style"):
            super().set_cdata_mode(elem, **options)

    def flush(self):
        text = _WHITE.sub(" ", "".join(self.run)).strip()
        if text:
            self.blocks.append((text, [x for _, marks in self.stack for x in marks], self.linked))
        self.run, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if self.hidden == ["head"] and tag not in HEAD or tag == "body" and self.hidden[:1] == ["head"]:
            self.hidden.clear()
        if self.hidden:
            if tag not in VOID:
                self.hidden.append(tag)
            return
        if tag in HIDDEN:
            if tag != "head" or not self.headed:
                self.hidden.append(tag)
                self.headed |= tag == "head"
            return
        if tag == "a":
            self.links = 1
        if tag in ("br", "img"):
            self.run.append(" ")
        if tag not in BLOCKS | FALLBACK:
            return
        self.flush()
        if self.stack and self.stack[-1][0] == "p" and tag not in FALLBACK:
            self.stack.pop()
        if tag in ENDS:
            ends, until = ENDS[tag]
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in until:
                    break
                if self.stack[i][0] in ends:
                    del self.stack[i:]
                    break
        if tag not in VOID:
            named = [w.lower() for k, v in attrs if k in ("class", "id", "role") and v for w in _WORD.findall(v)]
            self.stack.append((tag, [tag, *("." + w for w in named)]))

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
                return
            if tag not in (name for name, _ in self.stack):
                return
            self.hidden.clear()  # an enclosing element ends, and so does what it holds
        if tag == "a":
            self.links = 0
        if tag not in BLOCKS | FALLBACK:
            return
        self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if self.hidden == ["head"] and data.strip():
            self.hidden.clear()
        if not self.hidden:
            self.run.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str) -> list[tuple[str, list[str], int]]:
    """(text, tags and classes from the outermost down, characters in links) of each leaf block, in page order."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks
