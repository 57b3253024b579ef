"""A small tolerant HTML reader: block elements as a tree, text blocks in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own first end tag, and never text of the page.
RAW = "script|style|textarea|title|iframe|noembed|noframes"
#: Form controls and what is not shown: left out where they are closed within the block they stand in.
UNSEEN = frozenset("template select button datalist".split())
BLOCKS = frozenset(
    "html body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd menu table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption form fieldset legend address details summary dialog hr search center label noscript".split()
)
CLOSES_P = BLOCKS - frozenset("html body caption thead tbody tfoot tr td th li dt dd legend label summary figcaption".split())
#: An opening tag ends an open element of these kinds, up to the container named.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)),
}
#: A comment, a raw element as a whole, another declaration, a tag, or text, whichever comes first.
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1(?=[\s/>])[^>]*+>?|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)|([^<]++|<)", re.S | re.I
)
ATTR = re.compile(r"\b(class|id|role|aria-label|hidden|style)\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Dom:
    """Nodes in page order; a parent comes before its children."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (node, text)


def _unseen(tokens: list[tuple]) -> dict[int, int]:
    """Places of the start and end tags of ``UNSEEN`` elements that are closed within the block they stand in."""
    ends: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    for i, (_, slash, tag, attrs, _) in enumerate(tokens):
        tag = (tag or "").lower()
        if tag in UNSEEN or tag in BLOCKS - VOID:
            if not slash:
                open_.append((tag, i))
            elif any(t == tag for t, _ in open_):
                while (top := open_.pop())[0] != tag:
                    pass
                if tag in UNSEEN:
                    ends[top[1]] = i
    return ends


def read(page: str | None) -> Dom:
    """Blocks of a page. Inline tags are dropped without a gap; ``br`` counts as white space.

    References are decoded once; white space inside a block becomes one space.
    Comments, scripts, styles and the like are whole tokens, found in one pass, so
    that one cannot start inside another. A form control that is never closed
    hides nothing: its tag is passed over.
    """
    dom = Dom()
    stack = [0]
    text: list[str] = []
    links = 0
    in_link = False
    tokens = [m.groups() for m in TOKEN.finditer(page or "")]
    ends = _unseen(tokens)
    skip = -1

    def flush() -> None:
        nonlocal links
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            if t:
                node = stack[-1]
                dom.blocks.append((node, t))
                dom.chars[node] += len(t)
                dom.linked[node] += min(links, len(t))
            text.clear()
        links = 0

    def close(kinds: tuple[str, ...], until: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = dom.tag[stack[i]]
            if tag in kinds:
                flush()
                del stack[i:]
                return
            if tag in until:
                return

    for at, (_, slash, tag, attrs, plain) in enumerate(tokens):
        if at <= skip:
            continue
        if plain is not None:
            text.append(plain)
            if in_link:
                links += len(plain)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if tag == "a":
                in_link = False
            elif tag in BLOCKS and any(dom.tag[i] == tag for i in stack):
                flush()
                while dom.tag[stack.pop()] != tag:
                    pass
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = True
        elif tag in UNSEEN:
            skip = ends.get(at, skip)
        elif tag in BLOCKS:
            flush()
            if tag in CLOSES_P:
                close(("p",), ("table", "td", "th", "li", "div", "section", "article", "body", "button"))
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in VOID:
                continue
            found = {k.lower(): v.strip("\"'").lower() for k, v in ATTR.findall(attrs)}
            names = tuple(WORD.findall(" ".join(found.get(k, "") for k in ("class", "id", "role", "aria-label"))))
            if "display:none" in found.get("style", "").replace(" ", "") or re.search(r"\shidden(?:[\s=/]|$)", attrs):
                names += ("hidden",)
            dom.tag.append(tag)
            dom.parent.append(stack[-1])
            dom.names.append(names)
            dom.chars.append(0)
            dom.linked.append(0)
            stack.append(len(dom.tag) - 1)
    flush()
    return dom
