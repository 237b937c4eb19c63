"""A small DOM: elements and runs of text in page order, with the repairs that browsers make most."""

from __future__ import annotations

import html
import re

#: Elements of HTML by how they are parsed and laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head script style template noscript title textarea iframe svg math select option object audio video canvas".split())
#: An element's start ends these open ones, up to the nearest of the scopes.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("html body table ul ol dl select div section article aside main nav td th".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul li dt dd tr td th".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[!?][^>]*(?:>|\Z)|/[^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")


class Dom:
    """Nodes in page order: parent, tag ('#text' for a run of text), attribute tokens, text; the root is node 0.

    breaks: for a run of text, whether a block begins before it.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.tokens, self.text, self.breaks, self.mark = [-1], ["#root"], [()], [""], [True], [None]
        self._parse(page)

    def _add(self, parent: int, tag: str, tokens: tuple = (), text: str = "", breaks: bool = False, mark: str | None = None) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.text.append(text)
        self.breaks.append(breaks)
        self.mark.append(mark)
        return len(self.tag) - 1

    def _parse(self, page: str) -> None:
        stack, at, fresh, tags = [0], 0, True, self.tag
        search, end = _TAG.search, len(page)
        while at < end:
            m = search(page, at)
            stop = m.start() if m else end
            if stop > at:
                text = page[at:stop]
                if "&" in text:
                    text = html.unescape(text)
                self._add(stack[-1], "#text", text=text, breaks=fresh)
                fresh = False
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if name not in INLINE:
                fresh = True
            if m[1]:
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == name:
                        del stack[depth:]
                        break
                    if tags[stack[depth]] in ("td", "th", "table") and name in INLINE:
                        break
                continue
            if name in ENDS_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == "p":
                        del stack[depth:]
                        break
                    if tags[stack[depth]] not in INLINE:
                        break
            if closes := ENDS.get(name):
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] in closes:
                        del stack[depth:]
                        break
                    if tags[stack[depth]] in SCOPES:
                        break
            tokens, mark = (), None
            if len(m[3]) > 3:
                found = []
                for k, a, b, c in _ATTR.findall(m[3]):
                    k = k.lower()
                    if k in ("class", "id", "role", "aria-label", "itemprop"):
                        found += _WORDS.findall((a or b or c).lower())
                    elif k == "hidden" or k == "style" and "display:none" in (a or b or c).replace(" ", ""):
                        found.append("hidden")
                    elif k == "data-k":
                        mark = a
                tokens = tuple(found)
            node = self._add(stack[-1], name, tokens, mark=mark)
            if name in VOID or m[3].endswith("/") and name not in RAW:
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                body = page[at : close.start() if close else end]
                self._add(node, "#text", text=body)
                at = close.end() if close else end
                continue
            stack.append(node)
