"""Reading HTML into leaf blocks, in time and memory that grow with the page alone.

A page is scanned once. A block is a stretch of text between block-level tags; the open block-level elements around it
are a chain of nodes that blocks share, so a page of any depth takes as many nodes as it has tags. End tags that HTML
lets authors leave out are implied, each up to its container: p before block-level tags, li, dt, dd, option, and the
parts of tables. A quote that nothing closes is a plain character, so that an attribute never swallows the page.
"""

from __future__ import annotations

import bisect
import functools
import html as html_lib
import re
from dataclasses import dataclass, field

#: Fixed by HTML: elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed by HTML: elements that stay inside a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Fixed by HTML: elements whose content is no markup up to their own end tag.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements that are left out whole where their end tag is there.
LEFT_OUT = frozenset("svg noscript template object select datalist button canvas audio video math".split())
#: Fixed by HTML: tags before which an open p ends.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: Fixed by HTML: beyond these nothing is implied from inside.
SCOPE = frozenset("table td th caption".split())
TABLE = SCOPE | frozenset("tr tbody thead tfoot".split())
#: Fixed by HTML: which open elements a tag ends, and the containers that they are looked for in.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    **{h: (("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section", "article", "header", "main", "li")) for h in ("h1", "h2", "h3", "h4", "h5", "h6")},
}
#: A tag whose quoted values are closed; the last group is missing where they aren't.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^\"'>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(>)?")
_STOP = re.compile("[\"'>]")
_BEFORE = re.compile(r"=\s*+\Z")
_NAMED = re.compile(r"(?<![\w-])(class|id|role|itemprop|href|lang|charset|content)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_SPLIT = re.compile(r"[^a-z0-9à-ɏ]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CONCEALED = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*+:\s*+none")


class Node:
    """An open block-level element: its parent, depth, tag, and words of its naming attributes."""

    __slots__ = ("depth", "parent", "tag", "value", "words")

    def __init__(self, parent: Node | None, tag: str, words: tuple[str, ...]):
        self.parent, self.tag, self.words = parent, tag, words
        self.depth = parent.depth + 1 if parent else 0
        self.value = None  # for what a reader keeps about it

    def path(self) -> list[Node]:
        """The node and those around it, outwards."""
        out, node = [], self
        while node:
            out.append(node)
            node = node.parent
        return out


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    title: str = ""
    lang: str = ""
    links: list[str] = field(default_factory=list)
    #: Elements with blocks in or under them, ancestors first, where a reader has noted them.
    nodes: list[Node] = field(default_factory=list)


def plain(text: str) -> str:
    """Character references decoded, white space made single."""
    return " ".join((html_lib.unescape(text) if "&" in text else text).split())


def _remembered(fn):
    """fn with a cache for the short attribute texts that pages repeat."""
    cached = functools.lru_cache(maxsize=50_000)(fn)
    return lambda raw: cached(raw) if len(raw) < 500 else fn(raw)


@_remembered
def attributes(raw: str) -> tuple[tuple[str, str], ...]:
    """Lower-case names and values of the attributes that are read here."""
    return tuple((m[1].lower(), m[2] or m[3] or m[4] or "") for m in _NAMED.finditer(raw))


@_remembered
def names(raw: str) -> tuple[str, ...]:
    """The words of a tag's class, id, role and itemprop."""
    words: list[str] = []
    for name, value in attributes(raw):
        if name in ("class", "id", "role", "itemprop"):
            words += [w for w in _SPLIT.split(_CAMEL.sub(" ", value).lower()) if w]
    if _CONCEALED.search(raw):
        words.append("\0hidden")
    return tuple(dict.fromkeys(words))


class _Scan:
    """Places of a page, found without going over any part of it twice."""

    def __init__(self, page: str):
        self.page, self.none = page, {}
        self.lower = page.lower() if len(page.lower()) == len(page) else "".join(c.lower() if c.isascii() else c for c in page)

    def find(self, what: str, at: int, lower: bool = False) -> int:
        """Where `what` stands next, or -1; what isn't there once isn't looked for again."""
        if at >= self.none.get(what, len(self.page) + 1):
            return -1
        k = (self.lower if lower else self.page).find(what, at)
        if k < 0:
            self.none[what] = at
        return k

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag, over quoted values; the page's end if there is none."""
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            close = self.find(m[0], m.end()) if _BEFORE.search(self.page, max(0, m.start() - 64), m.start()) else -1
            at = close + 1 if close >= 0 else m.end()
        return len(self.page)

    def end_tag(self, tag: str, at: int) -> tuple[int, int] | None:
        """Where the next end tag of that name starts and ends."""
        while (k := self.find("</" + tag, at, lower=True)) >= 0:
            at = k + 2 + len(tag)
            if at >= len(self.page) or not (self.page[at].isalnum() or self.page[at] in "-_:"):
                return k, self.tag_end(at) + 1
        return None


def read(page: str | None) -> Page:
    """Blocks, title, language, link targets of a page."""
    out = Page()
    text = page or ""
    scan = _Scan(text)
    top = Node(None, "", ())
    stack = [top]
    places: dict[str, list[int]] = {}  # by tag: places of the open ones on the stack, rising
    held: list[str] = []
    linked, link = 0, None  # link: depth of the stack where a link is open
    concealed: list[int] = []  # places of open elements that aren't shown
    borders: list[int] = []  # places of open elements of SCOPE

    def end() -> None:
        nonlocal linked
        if held:
            t = plain("".join(held))
            if t and not concealed:
                out.blocks.append(Block(t, stack[-1], linked))
            held.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal link
        while len(stack) > to:
            places[stack.pop().tag].pop()
        while concealed and concealed[-1] >= to:
            concealed.pop()
        while borders and borders[-1] >= to:
            borders.pop()
        if link is not None and link > len(stack):
            link = None

    def end_p() -> None:
        if (open_p := places.get("p")) and (not borders or open_p[-1] > borders[-1]):
            pop(open_p[-1])

    def last(tags) -> int:
        return max([places[t][-1] for t in tags if places.get(t)], default=0)

    at, n = 0, len(text)
    while at < n:
        k = scan.find("<", at)
        stop = k if k >= 0 else n
        if stop > at:
            held.append(text[at:stop])
            if link is not None:
                linked += stop - at
        if k < 0:
            break
        m = _TAG.match(text, k)
        if not m:
            at = k + 1
            if text.startswith("!--", at):
                close = scan.find("-->", at + 3)
                at = close + 3 if close >= 0 else n
            elif text.startswith("![CDATA[", at):
                close = scan.find("]]>", at)
                at = close + 3 if close >= 0 else n
            elif text[at : at + 1] in ("!", "?", "/"):
                close = scan.find(">", at)
                at = close + 1 if close >= 0 else n
            else:
                held.append("<")  # a sign, not a tag
                linked += link is not None
            continue
        closing, tag, raw, whole = m.groups()
        tag = tag.lower()
        if whole:
            at = m.end()
        else:
            stop = scan.tag_end(m.end(2))
            raw = text[m.end(2) : stop]
            at = min(n, stop + 1)
        if closing:
            if tag == "a":
                link = None
            if tag in INLINE:
                continue
            end()
            if tag in ("html", "body"):
                continue
            if places.get(tag):
                to = places[tag][-1]
                if tag in TABLE or not borders or to > borders[-1]:
                    pop(to)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in RAW or tag in LEFT_OUT:
            found = scan.end_tag(tag, at)
            if tag == "title" and not out.title:
                out.title = plain(text[at : found[0] if found else n])
            if found:
                if tag in RAW and tag != "textarea" or tag in ("noscript", "template"):
                    end()
                at = found[1]
            elif tag in RAW:
                at = n
            continue
        if tag in ("a", "area"):
            target = next((v for name, v in attributes(raw) if name == "href"), None)
            if target is not None:
                out.links.append(html_lib.unescape(target).strip())
            if tag == "a":
                link = len(stack) if target is not None else None
            continue
        if tag in INLINE:
            continue
        if tag in ("html", "body", "head"):
            if tag == "html":
                out.lang = out.lang or next((v for name, v in attributes(raw) if name == "lang"), "")
            continue
        end()
        if tag in VOID:
            if tag == "hr":
                end_p()
            continue
        if tag in ENDS_P:
            end_p()
        if tag in ENDS:
            ended, within = ENDS[tag]
            border = last(within)
            to = min((places[t][i] for t in ended if places.get(t) for i in (_first_after(places[t], border),) if i is not None), default=0)
            if to:
                pop(to)
        words = names(raw)
        stack.append(Node(stack[-1], tag, words))
        places.setdefault(tag, []).append(len(stack) - 1)
        if tag in SCOPE:
            borders.append(len(stack) - 1)
        if "\0hidden" in words:
            concealed.append(len(stack) - 1)
    end()
    return out


def _first_after(rising: list[int], border: int) -> int | None:
    """The place in a rising list of the first value above border."""
    k = bisect.bisect_right(rising, border)
    return k if k < len(rising) else None
