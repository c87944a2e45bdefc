"""A small, forgiving HTML tree: block nodes, their texts and their attributes."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
#: Whatever is in them is never shown as text.
HIDDEN = frozenset("script style textarea title noscript iframe xmp noembed noframes head template svg select object canvas audio video datalist annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = BLOCK - frozenset("html body option optgroup tbody td tfoot th thead tr caption legend".split())
#: A start tag closes these open ones, up to the nearest of the stops.
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_IMPLIED["tfoot"] = _IMPLIED["thead"] = _IMPLIED["tbody"]


@dataclass
class Node:
    """A block element, or (tag ``#text``) a run of inline content beside block children."""

    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    text: list[str] = field(default_factory=list)
    links: int = 0  # characters inside links
    anchors: int = 0
    inline: int = 0  # inline elements
    controls: int = 0  # inputs, buttons
    hidden: bool = False


def _tokens(raw: str) -> tuple[str, ...]:
    out = []
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label", "name"):
            out += _TOKEN.findall(_CAMEL.sub(" ", a or b or c).lower())
        elif name == "hidden" or (name == "style" and "display:none" in (a or b).replace(" ", "").lower()) or (name == "aria-hidden" and (a or b or c) == "true"):
            out.append("(hidden)")
    return tuple(out)


def parse(source: str | None) -> list[Node]:
    """All nodes in page order; node 0 is the root.  Texts are raw pieces of block leaves and ``#text`` runs."""
    source = source or ""
    nodes = [Node("#root", -1, 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements, inline ones too, with the block they are in
    run = [-1]  # the open #text run of each open block
    links = 0
    hidden = 0  # the length of the stack when a hidden element began, or 0

    def put(piece: str) -> None:
        if hidden or not piece:
            return
        block = stack[-1][1]
        if run[-1] < 0:
            if not piece.strip():
                return
            run[-1] = len(nodes)
            nodes.append(Node("#text", block, nodes[block].depth + 1))
        piece = html.unescape(piece) if "&" in piece else piece
        own = nodes[run[-1]]
        own.text.append(piece)
        if links:
            own.links += len(piece.strip())

    def pop(to: int) -> None:
        nonlocal hidden, links
        while len(stack) > to:
            tag, _ = stack.pop()
            if tag in BLOCK:
                run.pop()
                run[-1] = -1
            elif tag == "a":
                links -= 1
        if hidden > len(stack):
            hidden = 0

    def close(tags: frozenset, stops: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in stops:
                return
            if stack[k][0] in tags:
                pop(k)
                return

    at, end = 0, len(source)
    while at < end:
        m = _TAG.search(source, at)
        if not m:
            put(source[at:])
            break
        put(source[at : m.start()])
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            if m.group().startswith("<![CDATA["):
                put(m.group()[9:-3] if m.group().endswith("]]>") else m.group()[9:])
            continue
        if m.group(5) and not m.group().endswith(">"):
            break  # cut off inside a tag
        if m.group(1) or m.group(4):
            if tag == "p" and not any(t == "p" for t, _ in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break  # an inline end tag does not reach out of its block
            if tag == "br":
                put(" ")
            continue
        raw = m.group(3) or m.group(6) or ""
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in ("td", "th", "table", "button", "object", "div", "li", "article", "section"):
                    break
        if tag in _IMPLIED:
            close(*_IMPLIED[tag])
        if tag == "a":
            close(frozenset("a"), BLOCK)
        block = stack[-1][1]
        if tag in VOID:
            if tag in ("br", "wbr", "img", "hr"):
                put(" " if tag != "wbr" else "")
            if tag == "hr":
                run[-1] = -1
            if tag == "input":
                nodes[block].controls += 1
            continue
        if tag in BLOCK:
            nodes.append(Node(tag, block, nodes[block].depth + 1, _tokens(raw)))
            run[-1] = -1
            stack.append((tag, len(nodes) - 1))
            run.append(-1)
            if "(hidden)" in nodes[-1].tokens:
                nodes[-1].hidden = True
                hidden = hidden or len(stack)
        else:
            stack.append((tag, block))
            if run[-1] >= 0:
                nodes[run[-1]].inline += 1
            if tag == "a":
                links += 1
                nodes[block].anchors += 1
            elif tag == "button":
                nodes[block].controls += 1
        if tag in HIDDEN:
            hidden = hidden or len(stack)
        if tag in RAW:
            stop = RAW[tag].search(source, at)
            if tag in ("textarea", "button"):
                nodes[block].controls += 1
            at = stop.start() if stop else end
        elif raw.rstrip().endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span"):
            pop(len(stack) - 1)
    return nodes


def clean(pieces: list[str]) -> str:
    """White space of a block into single spaces, trimmed."""
    return " ".join("".join(pieces).split())
