"""A page as a tree of blocks: lenient parsing of HTML in one scan, without recursion.

Nodes are the elements that structure a page and the text blocks in them; inline elements
belong to the block that they stand in. Parents come before their children. Every step
looks at each character a bounded number of times, whatever is unclosed or crossed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements that belong to the text around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr picture slot "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle "
    "msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Void elements that leave a text whole.
UNSEEN = frozenset("area base embed img link meta param source track".split())
#: What these hold is never text of the page: no content (script, style, svg, template), parts of forms, a formula's
#: source beside the formula, or what is shown only where something else can't be (noscript, object, canvas and the like).
DROPPED = frozenset("title noscript template svg annotation annotation-xml object iframe select datalist canvas audio video script style textarea option noframes".split())
#: What these hold is no markup: it ends at their end tag only.
RAW = frozenset("script style textarea title xmp iframe noframes".split())
#: Elements of a head; anything else, and text, is where the body begins.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Start tags that end an open element of these names.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
#: The attribute that labels a page to train on; parse() reads it on request only.
LABEL = "data-tidemark-label"

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_EDGE = re.compile(r">|=\s*[\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_LONG_REF = re.compile(r"&#(?:0*([1-9]\d*)|[xX]0*([1-9a-fA-F][0-9a-fA-F]*));?")


class Node:
    __slots__ = ("parent", "tag", "marks", "label", "text", "chars", "linked", "words", "kids")

    def __init__(self, parent: int, tag: str, marks: tuple[str, ...], label: int):
        self.parent, self.tag, self.marks, self.label = parent, tag, marks, label
        self.text: str | None = None
        self.chars = self.linked = self.words = self.kids = 0


def _inline(tag: str) -> bool:
    """Whether a tag leaves the block around it whole; so do tags of one's own, whose names have a hyphen."""
    return tag in INLINE or "-" in tag and tag not in DROPPED


def unescape(text: str) -> str:
    """Character references decoded; numbers beyond Unicode, of any length, are U+FFFD."""
    if "&" not in text:
        return text
    short = lambda m: m[0] if len(m[1] or m[2]) < 8 else "�"
    return html.unescape(_LONG_REF.sub(short, text))


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, is an end tag, attributes) of each tag, comments and the like with no name.

    What stands between them is text. A tag that the page's end cuts off takes the rest.
    """
    at, n = 0, len(page)
    endless: set[str] = set()  # raw elements that nothing closes from here on
    while (at := page.find("<", at)) >= 0:
        closing = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                end = n if end < 0 else end + 3
            elif page[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < n:
                end = page.find(">", at)
                end = n if end < 0 else end + 1
            else:
                at += 1  # a sign of its own
                continue
            yield at, end, "", False, ""
            at = end
            continue
        name, i, end = m[0].lower(), m.end(), n
        while e := _EDGE.search(page, i):
            i = e.end()
            if page[i - 1] == ">":
                end = i
                break
            i = page.find(page[i - 1], i) + 1 or i  # behind the quote, if one closes it
        yield at, end, name, closing, page[m.end() : end - 1] if e else ""
        at = end
        if name in RAW and not closing:
            found = None if name in endless else _RAW_END[name].search(page, at)
            if found:
                stop = found.start()
            elif name in ("script", "style"):
                stop = n
            else:  # nobody closed it: its text ends with the next tag
                endless.add(name)
                stop = page.find("<", at)
                stop = n if stop < 0 else stop
            if name != "xmp":
                yield at, stop, "", False, ""
                at = stop
            elif stop > at and found:  # literal text: no tag is looked for in it
                at = stop


def _marks(attrs: str, labels: bool) -> tuple[tuple[str, ...], int | None]:
    """Word parts of class, id and role; the label of a page to train on."""
    marks, label = [], None
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if labels and name == LABEL:
            label = int(value)
        elif name in ("class", "id", "role"):
            marks += [m.lower() for m in _PART.findall(value)]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            marks.append("hidden")
    return tuple(dict.fromkeys(marks)), label


def _closed(tags: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """Numbers of the end tags of those DROPPED elements that are closed, by their start tags' numbers."""
    open_: dict[str, list[int]] = {}
    pairs = {}
    for i, (_, _, name, closing, attrs) in enumerate(tags):
        if name in DROPPED:
            if not closing:
                if not (attrs.endswith("/") and name == "svg"):
                    open_.setdefault(name, []).append(i)
            elif open_.get(name):
                pairs[open_[name].pop()] = i
    return pairs


def parse(page: str, labels: bool = False) -> list[Node]:
    """The nodes of a page in page order; a block of text is a node named #text.

    A DROPPED element goes with all in it up to its end tag; one without an end tag ends
    at the next tag of a block. Head and body need no tags of their own.
    """
    nodes = [Node(-1, "#root", (), 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open blocks: (tag, node)
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    pending: list[str] = []
    linked, link = 0, 0  # link: height of the stack in which a link is open
    mute = False  # behind the start of a DROPPED element that nothing closes

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            at = stack[-1][1]
            n = Node(at, "#text", (), nodes[at].label)
            n.text, n.chars, n.linked, n.words = text, len(text), min(linked, len(text)), text.count(" ") + 1
            nodes.append(n)
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal link
        for tag, _ in stack[k:]:
            places[tag].pop()
        del stack[k:]
        if link > len(stack):
            link = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not mute:
            text = unescape(raw)
            if stack[-1][0] == "head" and not text.isspace():
                flush()
                pop_to(len(stack) - 1)
            pending.append(text)
            if link:
                linked += len(text)

    tags = list(_tags(page))
    ends = _closed(tags)
    i = end = 0
    while i < len(tags):
        start, stop, tag, closing, attrs = tags[i]
        if start >= end:
            add(page[end:start])
        end = stop
        i += 1
        if not tag:
            continue
        if tag == "br":
            pending.append(" ")
            continue
        if tag in UNSEEN:  # no white space: what stands around it is one word
            continue
        if closing:
            if tag == "a":
                link = 0
            if not _inline(tag):
                flush()
                mute = False
                if places.get(tag):
                    pop_to(places[tag][-1])
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            flush()
            pop_to(len(stack) - 1)
        if _inline(tag):
            if tag == "a":
                link = len(stack)
            continue
        if tag in DROPPED and (last := ends.get(i - 1)) is not None:  # gone, with all in it; the block around it goes on
            end, i = tags[last][1], last + 1
            continue
        flush()
        mute = False
        if tag in DROPPED:
            mute = tag not in ("title", "textarea", "iframe", "noframes", "script", "style", "svg")
            continue
        if tag in VOID or tag in ("html", "head", "body") and places.get(tag):
            continue
        while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] in ENDS.get(tag, ())):
            pop_to(len(stack) - 1)
        at = stack[-1][1]
        marks, label = _marks(attrs, labels) if attrs else ((), None)
        nodes.append(Node(at, tag, marks, nodes[at].label if label is None else label))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, len(nodes) - 1))
    add(page[end:])
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        p = nodes[n.parent]
        p.chars += n.chars
        p.linked += n.linked
        p.words += n.words
        p.kids += 1
    return nodes
