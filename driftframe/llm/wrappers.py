"""Union-free regular expressions over page structure, inferred by aligning the pages of a host one after the other.

An expression is a sequence of elements, each with a key (tag and names), flags for optional (?) and repeated (+), a text slot
and inner elements. A page alone gives an expression whose runs of like siblings, of period 1 to 3, are folded into repeated
groups. Two expressions are aligned element by element: what stands in one only turns optional, equal neighbours turn into a
repeated group, and unequal strings turn into a slot that varies. No alternatives (unions) ever arise. merge() may be applied in
any order and grouping, so wrappers are built from partial ones.

Which strings are the template's is told by counting: those that nearly all of a host's distinct pages show at one path, a page
counted once however many copies it has. Counts holds that over all pages of a host, from the (path, string) pairs that
expression() notes; the operator always passes it. For a few pages without a table of counts, an element keeps which strings it held
on which of MARKS pages.
Decision reads off a wrapper where the article is: in the repeated group with most text that varies and stands outside links.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b

from driftframe.llm.html_tree import INLINE, Node, squeeze

#: Above so many inner elements, like ones are folded wherever they stand: the expression (a? b? ...)+, which no page contradicts.
WIDE = 48
#: Distinct pages, taken by digest, on which strings are told apart where no Counts are given.
MARKS = 24
#: Share of a host's distinct pages that a template's string is on.
NEARLY_ALL = 0.9
#: Most of an article's strings that can be the template's: where more of them agree, the pages are copies of one another.
MOST_FIXED = 0.5
#: An element beside the article's core belongs to the article if its strings are at least this long against the core's.
ALIKE = 0.5
#: By how much a name that tells an article weighs more.
NAMED = 1.25

#: Elements, and words in class, id or role, that name what is not the article.
DROP_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe object embed svg canvas button select option input textarea title dialog menu map audio video fieldset".split()
)
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner banners breadcrumb breadcrumbs comment comments commentlist disqus replies responses cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts footer masthead topbar navbar nav navigation menu menus sidebar sidebars widget widgets related recommended recommendations share sharing social sponsor sponsored "
    "promo promotion newsletter subscribe subscription signup login popup modal overlay pagination pager hidden search contentinfo complementary dialog".split()
)
#: Words that may stand beside those in one name.
GLUE_WORDS = frozenset("area bar block box button buttons column container content form icons inner item items left link links list main message outer page post posts reader right row section site skip slot text top unit user wrap wrapper bottom".split())
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:articlebody|article-body|article-content|post-content|post-body|entry-content|story-body|main-content|maincontent|content-body|main)(?:$|[\s_-])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def key_of(node: Node) -> str:
    return node.tag if not node.name else node.tag + "." + re.sub(r"\d+", "0", node.name)


def tag_of(key: str) -> str:
    return key.partition(".")[0]


def _telling(name: str) -> bool:
    """Whether one of the names is made of words that tell what is no article, and of glue."""
    for one in name.split():
        words = [w for w in re.split(r"[_0-9-]+", one) if w]
        if any(w in DROP_WORDS for w in words) and all(w in DROP_WORDS or w in GLUE_WORDS for w in words):
            return True
    return False


def dropped(key: str, inside: bool, by_name: bool = True) -> bool:
    """Whether an element is no part of an article by its tag or names; a header counts as one outside the article only."""
    tag, _, name = key.partition(".")
    if tag in DROP_TAGS or (tag == "header" and not inside):
        return True
    return by_name and bool(name) and tag not in ("html", "body", "article", "main") and _telling(name)


#: In place of a string's digest: the pages on which the element stands.
HERE = ""


class Element:
    """One element of an expression. chars, links, times: characters in its slot over all pages, those of them in links, and how many
    strings they make up; strings: digest of each string to the marks of the pages that show it here, among the pages that are marked;
    HERE stands for the element itself."""

    __slots__ = ("chars", "inner", "key", "links", "optional", "repeated", "strings", "text", "times")

    def __init__(self, key: str, inner: list[Element] | None = None, text: str | None = "", chars: int = 0, links: int = 0, times: int = 0, optional: bool = False, repeated: bool = False, strings: dict[str, set[int]] | None = None):
        self.key, self.inner, self.text, self.chars, self.links, self.times = key, inner or [], text, chars, links, times
        self.optional, self.repeated, self.strings = optional, repeated, strings or {}

    def pack(self, marks: frozenset[int] | None = None) -> list:
        """As plain lists; marks: the only ones that are kept."""
        strings = {s: sorted(seen if marks is None else seen & marks) for s, seen in self.strings.items()}
        strings = {s: seen for s, seen in sorted(strings.items()) if seen}
        return [self.key, self.text, self.chars, self.links, self.times, int(self.optional) + 2 * int(self.repeated), [e.pack(marks) for e in self.inner], strings]

    @staticmethod
    def unpack(x: list) -> Element:
        return Element(x[0], [Element.unpack(e) for e in x[6]], x[1], x[2], x[3], x[4], bool(x[5] & 1), bool(x[5] & 2), {s: set(seen) for s, seen in x[7].items()})

    def __str__(self) -> str:
        slot = "#" if self.text is None else repr(self.text) if self.text else ""
        mark = ("+" if self.repeated else "") + ("?" if self.optional else "")
        return f"{self.key}({slot}{' ' if slot and self.inner else ''}{' '.join(map(str, self.inner))}){mark}"


def _merged(a: Element, b: Element) -> Element:
    """One element for both."""
    strings = {s: set(seen) for s, seen in a.strings.items()}
    for s, seen in b.strings.items():
        strings.setdefault(s, set()).update(seen)
    text = a.text if a.text == b.text else None
    return Element(a.key, align(a.inner, b.inner), text, a.chars + b.chars, a.links + b.links, a.times + b.times, a.optional or b.optional, a.repeated or b.repeated, strings)


def fold(elements: list[Element]) -> list[Element]:
    """Runs of like elements, or of like pairs or triples, as repeated groups."""
    for period in (1, 2, 3):
        out: list[Element] = []
        i = 0
        while i < len(elements):
            keys = [e.key for e in elements[i : i + period]]
            j = i + period
            while len(keys) == period and [e.key for e in elements[j : j + period]] == keys:
                j += period
            if j > i + period:
                group = elements[i : i + period]
                for k in range(i + period, j, period):
                    group = [_merged(x, y) for x, y in zip(group, elements[k : k + period], strict=True)]
                for e in group:
                    e.repeated = True
                here = {HERE: set().union(*(e.strings.get(HERE, ()) for e in group))}
                out += group if period == 1 else [Element("+" + " ".join(keys), group, repeated=True, strings=here)]
                i = j
            else:
                out.append(elements[i])
                i += 1
        elements = out
    if len(elements) > WIDE:
        by: dict[str, Element] = {}
        for e in elements:
            by[e.key] = _merged(by[e.key], e) if e.key in by else e
            by[e.key].repeated = by[e.key].optional = True
        elements = list(by.values())
    return elements


def align(a: list[Element], b: list[Element]) -> list[Element]:
    """The least general sequence that covers both: longest common subsequence by key, the rest optional, then folded."""
    if [e.key for e in a] == [e.key for e in b]:
        return fold([_merged(x, y) for x, y in zip(a, b, strict=True)])
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].key == b[j].key else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i].key == b[j].key:
            out.append(_merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            a[i].optional = True
            out.append(a[i])
            i += 1
        else:
            b[j].optional = True
            out.append(b[j])
            j += 1
    return fold(out)


Wrapper = tuple[list[int], Element]


def merge(parts: list[Wrapper]) -> Wrapper:
    """One wrapper from partial ones, each with its marks in order."""
    marks, out = parts[0]
    for more, e in parts[1:]:
        marks = sorted({*marks, *more})[:MARKS]
        out = _merged(out, e)
    return marks, out


def page(html: str, root: Node, marks: list[int] = ()) -> Wrapper:
    """The wrapper of one page, for use without Counts; its strings are noted unless marks are full of lesser ones."""
    mark = int.from_bytes(blake2b(html.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big")
    noted = len(marks) < MARKS or mark < marks[-1]
    return [mark] if noted else [], expression(root, mark if noted else None)


def says(node: Node) -> bool:
    """Whether an element's own text has words outside links."""
    def unlinked(x: Node) -> str:
        return "".join(c if isinstance(c, str) else "" if c.tag == "a" else unlinked(c) for c in x.children if isinstance(c, str) or (c.tag in INLINE and not blocks_below(c)))

    return any(c.isalnum() for c in squeeze(unlinked(node)))


def inline_text(node: Node) -> tuple[str, int]:
    """Text of an inline element, and the characters of it inside links."""
    if node.tag in ("br", "wbr", "img"):
        return " ", 0
    out, links = [], 0
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
        elif c.tag in INLINE:
            t, k = inline_text(c)
            out.append(t)
            links += k
    text = "".join(out)
    return text, len(text) if node.tag == "a" else links


def blocks_below(node: Node) -> bool:
    """Whether an inline element holds block elements, and so is read as a block."""
    return any(not isinstance(c, str) and (c.tag not in INLINE or blocks_below(c)) for c in node.children)


def _said(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _number(text: str, at: int = 0) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, salt=at.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


def digest(text: str) -> str:
    return hexed(_number(text))


def hexed(number: int) -> str:
    """A string's digest, of its number in a table."""
    return f"{number & 0xFFFFFFFFFFFFFFFF:016x}"


#: The path of a page's root.
ROOT = 0


@lru_cache(maxsize=100_000)
def step(path: int, key: str) -> int:
    """The path, as a number, that a key leads on to."""
    return _number(key, path)


def counted(html: str, root: Node) -> tuple[int, Element, list[tuple[int, int | None, int]]]:
    """A page's digest, its wrapper without strings, and what it shows, each once: (path, string, 0), and for every path of an element
    (path, None, how many strings stand there)."""
    shown: dict[int, set[int]] = {}
    e = expression(root, None, shown)
    return _number(html), e, [x for path, strings in shown.items() for x in ((path, None, len(strings)), *((path, s, 0) for s in strings))]


class Counts:
    """Of a host's distinct pages: how many there are; places: by path, how many have an element there and how many (page, string)
    pairs there are; template: (path, string) on nearly all of them, with how many show it."""

    def __init__(self, pages: int, places: list[tuple[int, int, int]], template: list[tuple[int, int, int]]):
        self.pages = pages
        self.places = {path: (here, total) for path, here, total in places}
        self.template: dict[int, dict[str, int]] = {}
        for path, string, n in template:
            if n > 1:
                self.template.setdefault(path, {})[hexed(string)] = n


def expression(node: Node, mark: int | None = 0, shown: dict[int, set[int]] | None = None, path: int = ROOT) -> Element:
    """The expression of one page's element; mark: the page's, if its strings are noted; shown: takes the strings of all its elements by path."""
    parts, links, inner = [], 0, []
    for c in node.children:
        if isinstance(c, str):
            parts.append(c)
        elif c.tag in INLINE and not blocks_below(c):
            t, k = inline_text(c)
            parts.append(t)
            links += k
        elif c.tag not in ("script", "style", "noscript", "template"):
            inner.append(expression(c, mark, shown, ROOT if shown is None else step(path, key_of(c))))
    text = _said(parts)
    if shown is not None:
        shown.setdefault(path, set()).update([_number(text)] if text else ())
    return Element(key_of(node), fold(inner), text, len(text), links, int(bool(text)), strings=None if mark is None else {HERE: {mark}, digest(text): {mark}} if text else {HERE: {mark}})


def own_text(node: Node) -> str:
    """What the slot of a page's element holds: its text outside inner blocks, as in expression()."""
    return _said([c if isinstance(c, str) else inline_text(c)[0] for c in node.children if isinstance(c, str) or (c.tag in INLINE and not blocks_below(c))])


def constant(path: str, text_digest: str) -> str:
    """A template's string: its path of keys and its digest."""
    return f"{path}\n{text_digest}"


def below(elements: list[Element]) -> list[Element]:
    """Inner elements as they stand on a page: those of a group are no level of their own."""
    return [c for e in elements for x in e.inner for c in (x.inner if x.key[0] == "+" else [x])]


class Decision:
    """Where the article stands in a host's pages: main (keys from the root to its core), top (how many of them lead to the element that
    the article can't reach beyond), whole (whether all of that element is the article's), beside (paths under it that are not), fixed
    (strings of the template under it)."""

    def __init__(self, marks: list[int], root: Element, counts: Counts | None = None):
        self.marks = frozenset(marks)
        self.counts = counts
        self._constant: dict[int, frozenset[str]] = {}
        self._path: dict[int, int] = {}
        if counts:
            self._walk(root, ROOT)
        found = None
        for by_name in (True, False):
            found = found or self._core(root, by_name, True) or self._core(root, by_name, False)
        self.main = found or []
        depth = [i + 1 for i, k in enumerate(self.main) if tag_of(k) == "article"]
        self.whole = bool(depth)
        depth = depth or [i + 1 for i, k in enumerate(self.main) if tag_of(k) == "main" or MAIN_NAMES.search(k.partition(".")[2])]
        self.top = depth[-1] if depth else 0
        level = [root]
        for key in self.main[: self.top]:
            level = [c for c in below(level) if c.key == key]
        self.beside = [] if self.whole else sorted(self._beside(level, self.main[self.top :]))
        self.fixed = self._fixed(level)

    def _walk(self, e: Element, path: int) -> None:
        """Paths of all elements; those of a group stand where the group does."""
        self._path[id(e)] = path
        for c in e.inner:
            self._walk(c, path if c.key[0] == "+" else step(path, c.key))

    def share(self, e: Element) -> float:
        """Share of the pages on which e stands."""
        if self.counts:
            return self.counts.places.get(self._path[id(e)], (0, 0))[0] / max(1, self.counts.pages)
        return len(e.strings.get(HERE, self.marks) & self.marks) / max(1, len(self.marks))

    def constants(self, e: Element) -> frozenset[str]:
        """The template's strings in e's slot."""
        if self.counts:
            return frozenset(self.counts.template.get(self._path[id(e)], ()))
        if id(e) not in self._constant:
            least = max(2, NEARLY_ALL * len(self.marks))
            self._constant[id(e)] = frozenset(s for s, seen in e.strings.items() if s != HERE and len(seen & self.marks) >= least)
        return self._constant[id(e)]

    def varies(self, e: Element) -> float:
        """Share of the strings in e's slot that are not the template's."""
        if self.counts:
            path = self._path[id(e)]
            return 1.0 - sum(self.counts.template.get(path, {}).values()) / max(1, self.counts.places.get(path, (0, 0))[1])
        every = {s: len(seen & self.marks) for s, seen in e.strings.items() if s != HERE}
        total = sum(every.values())
        return 1.0 - sum(every[s] for s in self.constants(e)) / total if total else 1.0

    def weight(self, e: Element) -> float:
        """Characters of e's slot that look like an article's: varying, outside links."""
        return max(0.0, e.chars - 2.0 * e.links) * self.varies(e)

    def _all(self, e: Element, by_name: bool = True) -> list[Element]:
        """e and all elements below it but dropped ones."""
        return [e] + [x for c in below([e]) if not dropped(c.key, True, by_name) for x in self._all(c, by_name)]

    def _core(self, root: Element, by_name: bool, grouped: bool) -> list[str] | None:
        """Keys to the element whose repeated groups (grouped; else: whose inner elements or own slot) weigh most, by the share of pages on which it stands."""
        best, found = 0.0, None
        todo = [(root, [], 1.0)]
        while todo:
            x, path, named = todo.pop()
            body = 0.0 if grouped or path else self.weight(x)
            for c in x.inner:
                inner = c.inner if c.key[0] == "+" else [c]
                for y in inner:
                    if dropped(y.key, False, by_name):
                        continue
                    if not grouped or y.repeated or c.key[0] == "+":
                        body += self.weight(y)
                    tells = tag_of(y.key) in ("article", "main") or MAIN_NAMES.search(y.key.partition(".")[2])
                    todo.append((y, [*path, y.key], NAMED if tells else named))
            body *= named * self.share(x)
            if body > best:
                best, found = body, path
        return found

    def _beside(self, level: list[Element], path: list[str]) -> list[str]:
        """Paths of elements beside the core that are no part of the article: only the template's, or in a container of other names with
        a string of the template's, or with strings much shorter than the core's."""
        core = level
        for key in path:
            core = [c for c in below(core) if c.key == key]
        said = [x for c in core for y in below([c]) if not dropped(y.key, True) for x in self._all(y) if self.weight(x) > 0 and tag_of(x.key) not in HEADINGS]
        usual = sum(self.weight(x) for x in said) / max(1.0, sum(x.times * self.varies(x) for x in said))
        out, at = [], ""
        for key in path:
            for c in below(level):
                if c.key == key or dropped(c.key, True) or tag_of(c.key) in HEADINGS:
                    continue
                every = [x for x in self._all(c) if x.times]
                varying = sum(x.times * self.varies(x) for x in every)
                fixed = any(self.constants(x) for x in every)
                length = sum(self.weight(x) for x in every) / max(varying, 1.0)
                if varying == 0 or ("." in c.key and (fixed or length < ALIKE * usual)):
                    out.append(f"{at}/{c.key}")
            level, at = [c for c in below(level) if c.key == key], f"{at}/{key}"
        return out

    def _fixed(self, level: list[Element]) -> list[str]:
        """Strings of the template below an element, unless they are so much of it that its pages are copies of one another."""
        found, fixed, every = [], 0.0, 0.0
        todo = [(c, f"/{c.key}") for c in below(level)]
        while todo:
            x, path = todo.pop()
            if dropped(x.key, True):
                continue
            found += [constant(path, s) for s in self.constants(x)]
            every += x.times
            fixed += x.times * (1.0 - self.varies(x))
            todo += [(c, f"{path}/{c.key}") for c in below([x])]
        return sorted(set(found)) if fixed <= MOST_FIXED * every else []
