"""A small, forgiving HTML tree: flat lists of nodes in document order, each with its parent.

One regular expression finds the markup; unclosed and misnested tags are mended by a few rules (void elements,
implied ends of p, li, dt, dd, tr, td, th, option). Nothing is dropped: comments and declarations are nodes too.
The places of the open elements are kept by name, so no tag has to search the stack: time is in proportion to the page.
"""

from __future__ import annotations

import re
from html import unescape

TEXT, COMMENT, DECLARATION = "#text", "#comment", "#declaration"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "td template tfoot th thead title tr ul".split()
)
_P_ENDS = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "head", "html", "body", "title", "legend", "template"}
#: A start tag ends the open elements of the first set, but looks no further up than one of the second.
_IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "tbody": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th")), frozenset(("table",))),
    "thead": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th")), frozenset(("table",))),
    "tfoot": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
}
_P = frozenset(("p",))
_P_SCOPE = frozenset(("table", "td", "th", "button", "caption", "html", "body"))

_ATTRS = r"""(?:[^>"']+|"[^"]*"|'[^']*')*"""
#: Groups: comment; declaration; end tag; name, attributes and text of an element whose text is raw; start tag and its attributes.
_MARKUP = re.compile(
    r"""<!--(.*?)(?:-->|\Z)|<[!?]([^>]*)>?|</([a-zA-Z][^\s/>]*)[^>]*>?"""
    rf"""|<((?ai:script|style))(?=[\s/>]|\Z)({_ATTRS})>?(.*?)(?:</(?i:\4)\b[^>]*>?|\Z)|<([a-zA-Z][^\s/>]*)({_ATTRS})>?""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


def attributes(raw: str) -> dict[str, str]:
    """Attributes of an element by lower-cased name, first occurrence wins."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class Dom:
    """``tag``, ``parent`` and ``data`` of each node; ``data`` is text, or the raw attributes of an element."""

    __slots__ = ("tag", "parent", "data")

    def __init__(self) -> None:
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.data: list[str] = [""]

    def add(self, tag: str, parent: int, data: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.data.append(data)
        return len(self.tag) - 1

    def attributes(self, node: int) -> dict[str, str]:
        return attributes(self.data[node])

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.tag]
        for node, parent in enumerate(self.parent):
            if parent >= 0:
                out[parent].append(node)
        return out


def parse_dom(html: str) -> Dom:
    dom = Dom()
    stack = [0]  # open elements
    places: dict[str, list[int]] = {}  # for each name where in the stack its open elements are

    def innermost(names: frozenset[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def cut(depth: int) -> None:
        for node in stack[depth:]:
            places[dom.tag[node]].pop()
        del stack[depth:]

    def close(names: frozenset[str], scope: frozenset[str]) -> bool:
        """End the innermost open element of these names, unless one of ``scope`` stands between."""
        at = innermost(names)
        found = at > 0 and at >= innermost(scope)
        if found:
            cut(at)
        return found

    tags, parents, texts = dom.tag, dom.parent, dom.data

    def add(tag: str, data: str) -> None:
        tags.append(tag)
        parents.append(top)
        texts.append(data)

    top = 0  # the innermost open element
    parts = _MARKUP.split(html)  # texts, each before the groups of one piece of markup
    for before, comment, declaration, end, raw, raw_attrs, raw_text, start, attrs in zip(*[iter(parts)] * 9):
        if before:
            add(TEXT, unescape(before))
        if end is not None:
            open_ = places.get(end.lower())
            if open_:
                if open_[-1] == len(stack) - 1:
                    open_.pop()
                    stack.pop()
                else:
                    cut(open_[-1])
                top = stack[-1]
        elif start is not None:
            name = start.lower()
            if name in _P_ENDS and places.get("p") and close(_P, _P_SCOPE):
                top = stack[-1]
            if name in _IMPLIED:
                ends, scope = _IMPLIED[name]
                if tags[top] not in scope:
                    while any(map(places.get, ends)) and close(ends, scope):  # all of the implied ends, innermost first
                        top = stack[-1]
            add(name, attrs)
            if name not in VOID and not attrs.endswith("/"):
                places.setdefault(name, []).append(len(stack))
                top = len(tags) - 1
                stack.append(top)
        elif comment is not None:
            add(COMMENT, comment)
        elif declaration is not None:
            add(DECLARATION, declaration)
        else:
            add(raw.lower(), raw_attrs)
            if raw_text:
                tags.append(TEXT)
                parents.append(len(tags) - 2)
                texts.append(raw_text)
    if parts[-1]:
        add(TEXT, unescape(parts[-1]))
    return dom
