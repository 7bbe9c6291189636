"""Text blocks of web pages: what stands between two block-level tags, with the tags around it."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|svg|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)[^>]*>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
#: Elements that stand within a line of text; any other element starts a new block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that is open is closed by the start of one of these.
CLOSED_BY = {
    "p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 article section aside nav header footer main form blockquote pre hr address figure li".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int


def names_in(attributes: str) -> tuple[str, ...]:
    """Words of an element's class, id and role, without plural s."""
    if "=" not in attributes:
        return ()
    found = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower()
    return tuple(w[:-1] if len(w) > 3 and w.endswith("s") else w for w in _PART.findall(found))


def blocks_of(page: str | None) -> list[Block]:
    """Blocks with text, in page order. Character references are decoded and white space is one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at, page = 0, False, 0, page or ""
    # no tag ends after the last of these, so none is looked for there (which would be a search to the end for each)
    end = page.rfind(">") + 1

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(stack), min(linked, len(text))))
            parts.clear()
        linked = 0

    for m in _TAG.finditer(page, 0, end):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        if at == end and (m[1] or m[0].startswith("<!--")) and not re.search(rf"</{m[1]}\s*>\Z" if m[1] else r"-->\Z", m[0], re.I):
            at = len(page)  # a comment or a script without end takes all the rest
            break
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing = m[2] or m[5]
        if name == "br":
            parts.append(" ")
        elif name in INLINE:
            if name == "a":
                in_link = not closing
        else:
            flush()
            in_link = False
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            else:
                while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                    stack.pop()
                if name not in VOID and not (m[4] or "").endswith("/"):
                    stack.append((name, names_in(m[4] or "")))
    if at < len(page):
        comment = page.find("<!--", max(at, end))
        parts.append(page[at : comment if comment >= 0 else len(page)])
    flush()
    return out


#: Width of the vectors of the path and of the words.
PATH, WORDS = 128, 16
WIDTH = PATH + WORDS + 6
_slots: dict[tuple[str, int], int] = {}


def slot(name: str, size: int) -> int:
    key = (name, size)
    if key not in _slots:
        if len(_slots) > 300_000:
            _slots.clear()
        _slots[key] = zlib.crc32(name.encode("utf-8", "replace")) % size
    return _slots[key]


def vector(block: Block, place: float) -> tuple[list[int], list[float]]:
    """Slots of the path and the other numbers of a block: hashed words, then sizes and shares."""
    path = []
    for depth, (tag, names) in enumerate(reversed(block.path)):
        path.append(slot(f"<{tag}", PATH))
        path.extend(slot(n, PATH) for n in names)
        if not depth:
            path.append(slot(f"={tag}", PATH))
    words = block.text.split()
    held = [0.0] * WORDS
    for w in words:
        held[slot(w, WORDS)] += 1
    n, size = len(words), len(block.text)
    stops = block.text.count(".") + block.text.count(",")
    rest = [min(1.0, size / 400), min(1.0, n / 12), block.linked / size, min(1.0, 10 * stops / size), place, float("©" in block.text)]
    return path, [h / n for h in held] + rest
