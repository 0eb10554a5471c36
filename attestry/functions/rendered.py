"""Rendered pages: a tree's blocks, their headings, what a reader sees of them, and the statements tagged in them.

A page is parsed once, from its first to its last character.  An element knows its heading as it opens: the nearest earlier sibling that is or
holds a heading, its own or an ancestor's, which is kept up to date on the way, so that no tree is walked afterwards.  Texts are
stretches of one list of pieces; an element is a range of it, and what a reader does not see is ranges inside.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import regex as re

from . import fixed
from .edits import last_sentence

_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))


@dataclass(eq=False)
class Element:
    tag: str
    classes: frozenset[str]
    parent: Element | None
    first: int  # its pieces are first to last
    section: Element | None  # the heading that it stands under
    href: str | None = None
    last: int = -1
    heading: Element | None = None  # the first heading inside
    under: Element | None = None  # what its next child's heading is, by the children so far
    index: int = -1  # its place among the page's elements; those inside it follow, up to stop
    stop: int = 0

    def within(self, tags: frozenset[str]) -> Element | None:
        """The nearest element of ``tags``, itself or above."""
        at: Element | None = self
        while at is not None and at.tag not in tags:
            at = at.parent
        return at


class Page(HTMLParser):
    """The elements and text pieces of a page; end tags that may be left out are."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.root = Element("body", frozenset(), None, 0, None)
        self.open = [self.root]
        self.elements: list[Element] = []
        self.feed(html)
        self.close()
        while len(self.open) > 1:
            self._shut()
        self.root.last, self.root.stop = len(self.pieces), len(self.elements)

    def _shut(self) -> None:
        e = self.open.pop()
        e.last, e.stop = len(self.pieces), len(self.elements)
        found = e if e.tag in _HEADINGS else e.heading
        if found is not None and e.parent is not None:
            e.parent.under = found
            e.parent.heading = e.parent.heading or found

    def _leave(self, tags: frozenset[str], limits: frozenset[str]) -> None:
        """Shuts everything up to the innermost open element of ``tags``, if there is one inside the innermost of ``limits``."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                while len(self.open) > k:
                    self._shut()
                return
            if self.open[k].tag in limits:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            if tag == "body":  # what stood before it is no sibling of what it holds
                while len(self.open) > 1:
                    self._shut()
                self.root.under = self.root.heading = None
            return
        for tags, by, limits in fixed.LEFT_OUT:
            if tag in by:
                self._leave(tags, limits)
        here = self.open[-1]
        given = dict(reversed(attrs))
        e = Element(tag, frozenset((given.get("class") or "").split()), here, len(self.pieces), here.under or here.section, given.get("href"))
        e.index = len(self.elements)
        self.elements.append(e)
        self.open.append(e)
        if tag in fixed.VOID_TAGS:
            self._shut()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._leave(frozenset([tag]), (fixed.TABLE_SCOPES if tag in fixed.TABLE_PARTS else fixed.SCOPES) - {tag})

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)

    # Texts

    def _unseen(self, e: Element, tags: frozenset[str], classes: frozenset[str]) -> list[tuple[int, int]]:
        """The ranges inside ``e`` of the outermost elements of these tags or classes."""
        out: list[tuple[int, int]] = []
        for x in self.elements[e.index + 1 : e.stop]:
            if (x.tag in tags or x.classes & classes) and (not out or x.first >= out[-1][1]):
                out.append((x.first, x.last))
        return out

    def text(self, e: Element, tags: frozenset[str] = frozenset(), classes: frozenset[str] = frozenset(), first: int | None = None, last: int | None = None) -> str:
        """The text of ``e`` (or of its pieces from ``first`` to ``last``) without elements of these tags or classes."""
        at, out = e.first if first is None else first, []
        end = e.last if last is None else last
        for a, z in [*self._unseen(e, tags, classes), (end, end)]:
            out += self.pieces[at : min(max(a, at), end)]
            at = max(at, z)
        return "".join(out)


def _spaced(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def section_text(page: Page, heading: Element | None) -> str | None:
    """A heading's words, without its edit links and footnotes; null if none are left."""
    return None if heading is None else page.text(heading, fixed.FOOTNOTE_TAGS, fixed.EDIT_CLASSES).strip() or None


def readable_text(page: Page, e: Element) -> str:
    return _spaced(page.text(e, fixed.FOOTNOTE_TAGS | {"style"}, fixed.UNREAD_CLASSES))


def link_targets(page: Page, block: Element, prefix: str = "/wiki/") -> list[str]:
    """The titles of the articles that a block links to, each once, in order; other namespaces and pages that do not exist are none."""
    out: dict[str, None] = {}
    for x in page.elements[block.index + 1 : block.stop]:
        if x.tag != "a" or not (x.href or "").startswith(prefix) or x.classes & fixed.NO_LINKS:
            continue
        try:
            title = unquote_to_bytes(x.href[len(prefix) :].split("#")[0]).decode()
        except UnicodeDecodeError:
            continue
        title = title.replace("_", " ").strip()
        if title and not re.match(fixed.NAMESPACES, title, re.I) and not re.search("%(?![0-9A-Fa-f]{2})", x.href[len(prefix) :].split("#")[0]):
            out.setdefault(title)
    return list(out)


def blocks(html: str, prefix: str = "/wiki/") -> list[tuple[str, str | None, str, list[str]]]:
    """(tag, heading, what a reader sees, links) of every block of a page, in order."""
    page = Page(html)
    return [(e.tag, section_text(page, e.section), readable_text(page, e), link_targets(page, e, prefix)) for e in page.elements if e.tag in fixed.BLOCK_TAGS]


def tagged(html: str, prefix: str = "/wiki/") -> list[tuple[str, str, str | None, list[str]]]:
    """(claim, context, heading, links) of every tag in a page: the sentence before it in its block.

    The tag's place is found in the block's text without footnotes, edit links and other tags; a tag inside one of these has no place, and
    the whole block is its claim.
    """
    page = Page(html)
    out = []
    for sup in page.elements:
        if sup.tag != "sup" or fixed.TAG_CLASS not in sup.classes:
            continue
        block = (sup.parent or page.root).within(fixed.BLOCK_TAGS) or sup.parent or page.root
        hidden = False
        at = sup.parent
        while at is not None and at is not block:
            hidden |= at.tag in fixed.FOOTNOTE_TAGS or bool(at.classes & fixed.UNREAD_CLASSES)
            at = at.parent
        section, links = section_text(page, block.section), link_targets(page, block, prefix)
        seen = fixed.FOOTNOTE_TAGS, fixed.UNREAD_CLASSES
        if hidden:
            text = _spaced(page.text(block, *seen))
            out.append((text, text, section, links))
            continue
        before = _spaced(page.text(block, *seen, last=sup.first))
        after = _spaced(page.text(block, *seen, first=sup.last))
        out.append((last_sentence(before) or before, _spaced(f"{before} {after}"), section, links))
    return out
