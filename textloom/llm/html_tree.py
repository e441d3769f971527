"""A forgiving reader of HTML that keeps what main-text extraction needs."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that begin a new block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of one of these ends an open p.
ENDS_P = BLOCK - frozenset("body caption html legend option optgroup tbody td tfoot th thead tr".split())
#: start tag -> (open elements that it ends, elements that shield them)
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "body": (("head",), ()),
}
#: In head, these only; another start tag ends it.
IN_HEAD = frozenset("title meta link script style base noscript template".split())

_token = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?|[\"'])*)>?", re.DOTALL
)
_attribute = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str]
    parent: Node | None = None
    #: Nodes, and texts with their character references decoded.
    children: list[Node | str] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if source.strip(" \t\r\n/"):
        for m in _attribute.finditer(source):
            value = next((x for x in m.groups()[1:] if x is not None), "")
            out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out


class _Open:
    """The open elements of a page, innermost last, with the places of each tag, so that none is searched for."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    @property
    def node(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> None:
        self.places[self.stack.pop().tag].pop()

    def innermost(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: tuple[str, ...], shields: tuple[str, ...] = ()) -> None:
        """End the innermost open element of `tags` and all inside it, unless a shield stands between."""
        at = self.innermost(tags)
        if at > self.innermost(shields):
            while len(self.stack) > at:
                self.pop()


def parse(page: str) -> Node:
    """The tree of a page; whatever the text, there is one. Time is linear in the page, however deep it nests."""
    root = Node("html", {})
    open_, at, end = _Open(root), 0, len(page)

    def add(text: str) -> None:
        if text:
            open_.node.children.append(html.unescape(text) if "&" in text else text)

    while at < end:
        m = _token.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not open_.places.get("p"):
                open_.node.children.append(Node("p", {}, open_.node))
            open_.close((tag,))
            continue
        attributes = _attributes(m[3])
        if tag == "html":
            root.attributes.update(attributes)
            continue
        if open_.node.tag == "head" and tag not in IN_HEAD:
            open_.pop()
        if tag in ENDS_P:
            open_.close(("p",), ("table", "button", "object", "td", "th", "caption"))
        if tag in ENDS:
            open_.close(*ENDS[tag])
        if tag in HEADINGS and open_.node.tag in HEADINGS:
            open_.pop()
        new = Node(tag, attributes, open_.node)
        open_.node.children.append(new)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            text = page[at : stop.start() if stop else end]
            new.children.append(html.unescape(text) if tag in ("title", "textarea") and "&" in text else text)
            at = stop.end() if stop else end
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCK and tag not in VOID:
            open_.push(new)
    return root


def postorder(root: Node) -> list[Node]:
    """All elements, children before parents, without recursion, as pages may nest deeply."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    out.reverse()
    return out


def preorder(root: Node) -> list[Node]:
    """All elements in page order, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def hashes(root: Node) -> dict[int, int]:
    """For each element that holds text, by id(): a signed 64-bit hash of its subtree's tags and texts.

    White space and attributes are left out: a menu is the same whichever of its entries is marked as the current one.
    """
    out: dict[int, int] = {}
    for node in postorder(root):
        parts = [str(out[id(c)]) if isinstance(c, Node) else " ".join(c.split()) for c in node.children if not isinstance(c, Node) or id(c) in out]
        if any(parts):
            x = xxhash.xxh64_intdigest("\x1f".join([node.tag, *parts]).encode("utf-8", "replace"))
            out[id(node)] = x - (1 << 64) if x >> 63 else x
    return out


def blocks(root: Node, dropped: set[int]) -> list[str]:
    """The texts of `root`'s blocks in page order, without elements whose id() is in `dropped`."""
    out: list[str] = []
    run: list[str] = []

    def finish() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        item, ended = stack.pop()
        if isinstance(item, str):
            run.append(item)
        elif ended:
            finish()
        elif id(item) not in dropped:
            if item.tag == "br":
                run.append(" ")
            elif item.tag in BLOCK:
                finish()
                stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children))
    finish()
    return out
