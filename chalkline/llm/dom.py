"""Leaf blocks of HTML pages: what stands between the boundaries of block elements, with what stands above it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Element kinds of HTML.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2
h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot
th thead title tr ul video""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe".split())  # skipped with what they hold
KEEPS = frozenset("button caption object table td th".split())  # an open paragraph outside them isn't closed by what begins inside
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article section main body td th blockquote aside nav form select".split())

#: Words of class, id and role by what they tell.
FAMILIES = {
    "content": "article post entry content story body main text prose",
    "menu": "nav menu breadcrumb breadcrumbs navbar navigation toc pagination pager tabs crumbs",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense advertorial",
    "notice": "cookie cookies consent gdpr notice alert warning disclaimer modal popup overlay toast dialog privacy announcement",
    "side": "sidebar side aside related widget recommended trending popular rail secondary complementary more",
    "comment": "comment comments disqus reply replies respond discussion reader readers thread",
    "form": "form subscribe newsletter signup login search contact register",
    "share": "share sharing social follow tags",
    "foot": "footer foot copyright legal colophon contentinfo",
    "head": "header masthead topbar branding logo banner tagline",
    "hidden": "hidden",
}
_FAMILY = {w: 1 << k for k, words in enumerate(FAMILIES.values()) for w in words.split()}
#: Elements whose presence above a block is a feature.
ABOVE = "article main section nav header footer aside form head table ul ol li figure blockquote dialog".split()
_ABOVE = {t: 1 << (len(FAMILIES) + k) for k, t in enumerate(ABOVE)}
ANCESTOR_BITS = len(FAMILIES) + len(ABOVE)

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z))", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile("[a-z]+")


@dataclass
class Block:
    text: str
    above: int  # bits of FAMILIES and ABOVE
    parent: str  # nearest block element
    linked: float  # share of characters inside links


def _bits(tag: str, attributes: str) -> int:
    bits = _ABOVE.get(tag, 0) | (_FAMILY["notice"] if tag == "noscript" else 0)
    if attributes:
        for m in _NAMES.finditer(attributes):
            for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower()):
                bits |= _FAMILY.get(w, 0)
        if _HIDDEN.search(attributes):
            bits |= _FAMILY["hidden"]
    return bits


def blocks_of(html: str) -> list[Block]:
    """The blocks in page order; white space inside is single spaces, character references are decoded, and blocks without text are left out.

    Unclosed elements end with what closes their parent; a tag cut off at the end of the page is no text.
    """
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # (tag, bits of it and all above)
    pieces: list[str] = []
    linked = links = at = 0

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                parent = next((t for t, _ in reversed(stack) if t in BLOCKS), "body")
                out.append(Block(text, stack[-1][1] if stack else 0, parent, min(linked / len(text), 1.0)))
            pieces.clear()
        linked = 0

    def pop(depth: int) -> None:
        nonlocal links
        for t, _ in stack[depth:]:
            links -= t == "a"
        del stack[depth:]

    while True:
        m = _TAG.search(html, at)
        text = html[at:m.start()] if m else html[at:]
        if text:
            pieces.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                close()
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if depth >= 0 and (tag in BLOCKS or not any(t in BLOCKS for t, _ in stack[depth:])):
                pop(depth)
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
                at = end.start() if end else len(html)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCKS:
            close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in KEEPS:
                    break
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        pop(k)
                        if tag != "tr":
                            break
                    elif stack[k][0] in SCOPES:
                        break
        if tag not in VOID:
            stack.append((tag, (stack[-1][1] if stack else 0) | _bits(tag, m[3])))
            links += tag == "a"
    close()
    return out
