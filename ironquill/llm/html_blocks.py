"""Leaf blocks of a page's DOM, with what stands above them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements that begin and end a block of text; all others stand inside a line.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section summary table tbody td
    tfoot th thead tr ul""".split())
#: Elements whose text is none of the page's: scripts, styles, what the head holds, and controls of forms.
SILENT = frozenset("script style noscript template head title select textarea button".split())
#: Elements that a head may hold; any other one, or text, ends a head that has no end tag.
_IN_HEAD = frozenset("head title meta link base basefont bgsound style script noscript template".split())
#: Elements that end a button or list of options left open: none of them can stand inside.
_NO_CONTROL = frozenset("article aside main section nav header footer h1 h2 h3 h4 h5 h6 p table ul ol dl blockquote pre form fieldset".split())
#: Other elements that are told apart by name; the rest count as one.
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark math q s samp small span strong sub sup svg time u var".split())
#: Words in class names and ids, by what they mean.
_HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager skip",
    "head": "header masthead banner logo branding hero",
    "foot": "footer foot colophon copyright legal bottom",
    "side": "sidebar side aside widget widgets rail related recommended popular trending more",
    "note": "cookie cookies consent notice alert popup modal overlay newsletter subscribe signup warning gdpr message toast",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion promoted adsense",
    "form": "form search login signin register input field contact",
    "talk": "comment comments reply replies discussion disqus respond reader readers thread feedback",
    "share": "share social sharing follow tags tag meta byline author date",
    "text": "article content post entry story body main text page maincontent articlebody prose copy",
}
_MEANING = {w: k for k, ws in _HINTS.items() for w in ws.split()}
_SPLIT = re.compile(r"[^a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that begins closes those open in the same container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINER = frozenset("ul ol menu dl table tbody thead tfoot select body div article section main aside nav footer header".split())
#: Attribute by which a labelled page tells of an element whether it is the article's (1) or not (0).
LABEL = "data-y"
#: Elements at which the search for those that a block closes must look.
_LOOKED_AT = _CONTAINER | SILENT | {"p"} | frozenset(t for ts in _CLOSES.values() for t in ts)


@dataclass(frozen=True)
class Above:
    """What stands above a block. Sets to which an element adds nothing are its parent's, so depth costs neither time nor memory."""

    tags: frozenset[str] = frozenset()
    hints: frozenset[str] = frozenset()
    nearest_tag: str = ""
    nearest_hint: str = ""
    label: str | None = None

    def inside(self, tag: str, names: str, label: str | None) -> Above:
        """The same with one more element around the block."""
        meanings = [m for w in _SPLIT.split(names) if w and (m := _MEANING.get(w) or _MEANING.get(w.rstrip("s")))]
        known = tag if tag in BLOCK or tag in _INLINE else "other"
        counts = (tag in BLOCK or bool(names)) and tag not in ("html", "body")
        tags = self.tags | {known} if counts and known not in self.tags else self.tags
        hints = self.hints if self.hints.issuperset(meanings) else self.hints.union(meanings)
        new = Above(tags, hints, known if counts else self.nearest_tag,
                    meanings[-1] if meanings else self.nearest_hint, self.label if label is None else label)
        return self if new == self else new


@dataclass
class Block:
    text: str
    above: Above
    linked: int = 0
    label: int | None = None
    words: list[str] = field(default_factory=list)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, Above, int]] = []  # tag, what a block in it has above, place of the last element looked at
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = self.silent = 0

    def flush(self, above: Above | None = None) -> None:
        """End the block, unless inside a silent element, where nothing is part of a line."""
        if self.silent:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            above = above or (self.stack[-1][1] if self.stack else Above())
            self.blocks.append(Block(text, above, self.linked, None if above.label is None else int(above.label == "1"), text.split()))
        self.parts, self.linked = [], 0

    def _pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop()[0]
            self.open[tag] -= 1
            self.silent -= tag in SILENT

    def _pop_tag(self, tag: str) -> None:
        """Leave the innermost open element of this name, if any."""
        while self.open[tag]:
            found = self.stack[-1][0]
            self._pop(len(self.stack) - 1)
            if found == tag:
                break

    def _leave_silent(self, tag: str) -> None:
        if tag == "body" or tag not in _IN_HEAD and self.stack and self.stack[-1][0] == "head":
            self._pop_tag("head")
        if tag in _NO_CONTROL:
            self._pop_tag("button")
            self._pop_tag("select")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._leave_silent(tag)
        if tag in BLOCK:
            self.flush()
            n = self.stack[-1][2] if self.stack else -1
            while n >= 0:
                found = self.stack[n][0]
                if found in _CLOSES.get(tag, ()) or found == "p":
                    self._pop(n)
                elif found in _CONTAINER or found in SILENT:
                    break
                n = self.stack[n - 1][2] if n else -1
        if tag in _VOID:
            self.parts.append(" ")
            return
        of = dict(attrs)
        names = " ".join(of.get(k) or "" for k in ("class", "id", "role")).strip().lower()
        above, last = self.stack[-1][1:] if self.stack else (Above(), -1)
        self.stack.append((tag, above.inside(tag, names, of.get(LABEL)), len(self.stack) if tag in _LOOKED_AT else last))
        self.open[tag] += 1
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # The slash ends no element in HTML.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        above = self.stack[-1][1] if self.stack else None
        if tag in BLOCK:
            self.flush()
        self._pop_tag(tag)
        if tag in BLOCK:  # a silent element may have ended with it
            self.flush(above)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._pop_tag("head")
        if not self.silent:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())


def leaf_blocks(html: str | None) -> list[Block]:
    """Blocks of text in page order, white space as one space; those of silent elements left out."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks
