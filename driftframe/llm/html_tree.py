"""A forgiving HTML reader: pages to trees of block elements whose inline content is text."""

from __future__ import annotations

import re
from html import unescape

#: Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
#: An opening tag that ends open elements of these tags, up to a boundary.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset()),
}
SCOPE = frozenset("html table td th caption button object template".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<(?=[a-zA-Z/])[^>]*\Z",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|itemprop|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


#: Elements nested deeper than this are read as neighbours, text and all.
DEEPEST = 150


class Node:
    """An element: tag, its naming attributes in lower case, children (nodes and text)."""

    __slots__ = ("children", "name", "tag")

    def __init__(self, tag: str, name: str = ""):
        self.tag, self.name, self.children = tag, name, []


def _name(attrs: str) -> str:
    if not attrs or not attrs.strip():
        return ""
    out = []
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("hidden")
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            out.append("hidden")
        elif key != "aria-hidden":
            out.append(value)
    return " ".join(out)


def parse(html: str) -> Node:
    """The tree of a whole page. Unclosed and unopened tags are mended as browsers do for the common cases."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(html)
    find = _TOKEN.search
    while at < n:
        m = find(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in ENDS:
            ends, until = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in until:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
                    if tag != "tr":
                        break
        node = Node(tag, _name(attrs))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            node.children.append(html[at : end.start()] if end else html[at:])
            at = end.end() if end else n
        elif tag not in VOID and not attrs.rstrip().endswith("/") and len(stack) <= DEEPEST:
            stack.append(node)
    return root


def squeeze(text: str) -> str:
    """Character references decoded, runs of white space made one space, trimmed."""
    return " ".join(unescape(text).split())
