"""Leaf blocks of an HTML page: the text between block-level tags, with the path of elements above it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements that begin and end a block of text.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag, and elements whose content is no text of the page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe script style svg math template textarea title".split())
#: Those of them that a page may close in the start tag itself, and those that reach to the end of a page without an end tag.
_SELF_CLOSED = frozenset("iframe svg math".split())
_TO_THE_END = frozenset("script style".split())
#: Elements that a start tag of the same kind (or of its group) closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """A run of text; path holds the features of the elements above it, outermost first."""

    text: str
    path: tuple[tuple[str, ...], ...]
    linked: float  # the share of its characters inside links


def _element(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id and role."""
    if "=" not in attributes:
        return (tag,)
    words = [w.lower() for m in _NAMES.finditer(attributes) for w in _PARTS.findall(m[1] or m[2] or m[3] or "")]
    return (tag, *(f".{w}" for w in words))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, with references decoded and white space folded; empty ones are left out."""
    found: list[Block] = []
    stack: list[tuple[str, ...]] = []
    text: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            folded = " ".join("".join(text).split())
            if folded:
                total = sum(len(x) for x in text)
                found.append(Block(folded, tuple(stack), linked / total))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        piece = html.unescape(raw) if "&" in raw else raw
        text.append(piece)
        if links:
            linked += len(piece)

    while m := _TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in _BLOCK:
                flush()
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if depth is not None:
                    del stack[depth:]
            elif tag == "a":
                links = max(0, links - 1)
            continue
        if tag in _RAW:
            if tag in _SELF_CLOSED and (m[3] or m[6] or "").endswith("/"):
                continue
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            if end is not None:
                at = end.start()
            elif tag in _TO_THE_END:
                at = len(page)  # what follows is code; without an end tag the others are taken as empty
        elif tag == "br":
            text.append(" ")
        elif tag in _BLOCK:
            flush()
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in _CLOSES and stack and stack[-1][0] in _CLOSES[tag]:
                stack.pop()
            if tag not in _VOID:
                stack.append(_element(tag, m[3] or m[6] or ""))
        elif tag == "a":
            links += 1
    if at < len(page):
        add(page[at:])
    flush()
    return found
