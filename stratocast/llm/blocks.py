"""The text blocks of an HTML page, in page order, with the path of open elements above each."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Fixed values of HTML: elements without an end, inline elements, elements whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msub msup msubsup msqrt mroot mover munder munderover mstyle mspace mpadded semantics".split())
RAW = frozenset("script style noscript template iframe object svg annotation annotation-xml textarea title".split())
#: Of these the ones that hide the rest of the page where they have no end; the others then end at the next tag.
ENDLESS = frozenset("script style".split())
#: What a new element of a kind closes, if it is open within the nearest of the elements that follow.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<close>>|\Z)|/?[a-zA-Z][^>]*(?:>|\Z)|/\Z)",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_EMPTY = re.compile(r"""(?:\A|[\s"'])/\Z""")  # the slash of `<br />`, not that of `<a href=/>`
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none""", re.I)


@dataclass
class TextBlock:
    """One block: decoded text with single spaces, its path as (element, names) from the outside in, and how many
    of its characters are in links."""

    text: str
    path: tuple[tuple[str, str], ...]
    link_chars: int


def _names(attributes: str) -> str:
    if "=" not in attributes:
        return ""
    found = " ".join((m[2] or m[3] or m[4] or "") for m in _NAMED.finditer(attributes)).lower()
    return f"{found} hidden".strip() if _HIDDEN.search(attributes) else found


def split_blocks(html: str | None) -> list[TextBlock]:
    """The blocks of a page. White space is single spaces, character references are decoded; a tag or comment that the
    end of the page cuts off is no text. A frame or the like hides all it holds, and without an end only what
    stands before the next tag; a drawing ends at the next block. Formulas are text."""
    if not html:
        return []
    out: list[TextBlock] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    path: tuple[tuple[str, str], ...] = ()
    linked, in_link, at = 0, 0, 0
    raw: str | None = None

    def flush() -> None:
        nonlocal linked
        if text:
            plain = " ".join(unescape("".join(text)).split())
            if plain:
                out.append(TextBlock(plain, path, linked))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal path, linked
        if piece:
            if not text or not path and piece.strip():
                path = tuple(stack)
            elif not "".join(text).strip() and piece.strip():
                path = tuple(stack)
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    pos = 0
    while True:
        if raw is not None:
            block = r"|(?=<(?:p|div|h[1-6]|ul|ol|dl|li|pre|table|blockquote)\b)" if raw == "svg" else ""  # which ends a drawing
            end = re.compile(rf"</{raw}\b[^>]*(?:>|\Z){block}", re.I).search(html, pos)
            if end is None and raw in ENDLESS:
                pos = at = len(html)
                break
            if end is None:
                pos = at = (html.find("<", pos) + 1 or len(html) + 1) - 1
            else:
                pos = at = end.end()
            raw = None
        m = _TAG.search(html, pos)
        if m is None:
            break
        if m.start() > at:
            add(html[at : m.start()])
        pos = at = m.end()
        name = m["name"]
        if name is None or not m["close"].startswith(">"):
            continue
        name = name.lower()
        inline = name in INLINE
        if not inline:
            flush()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(s[0] not in INLINE for s in stack[k:]):
                        flush()
                    for gone in stack[k:]:
                        in_link -= gone[0] == "a"
                    del stack[k:]
                    break
            continue
        attributes = m["attributes"]
        if name in RAW and not _EMPTY.search(attributes):
            raw = name
            continue
        if name in VOID or _EMPTY.search(attributes):
            continue
        if not inline:
            # a block closes an open paragraph, and an item closes the one before it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    for gone in stack[k:]:
                        in_link -= gone[0] == "a"
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
            if name in CLOSES:
                closes, within = CLOSES[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in within:
                        break
                    if stack[k][0] in closes:
                        del stack[k:]
                        break
        stack.append((name, _names(attributes) if attributes else ""))
        in_link += name == "a"
    if at < len(html):
        add(html[at:])
    flush()
    return out
