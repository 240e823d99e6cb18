"""One reader of markup for texts, links and dates, in time linear in the page's length whatever is broken in it.

What is looked for and not there (the end of a tag, of a comment, of a script, a
closing quote) is looked for once: a tag, comment or script that never ends takes
the rest of the page, and a quote that never closes is a letter like any other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: What can open a tag or a comment; any other "<" is text.
_OPEN = re.compile(r"<(?=[A-Za-z/!?])")
_STOP = re.compile(r"[>\"']")
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?+")
#: Elements whose content is no markup.
RAW = frozenset(["script", "style", "textarea", "title"])
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def attributes(source: str) -> dict[str, str]:
    """Names in lower case and values with their character references decoded; of repeated names the first."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _tag_end(source: str, at: int, gone: set[str]) -> int:
    """The place of the ``>`` that ends a tag, or -1; ``gone``: quotes that don't occur any more."""
    while m := _STOP.search(source, at):
        at = m.end()
        if m[0] == ">":
            return m.start()
        before = m.start() - 1
        while source[before].isspace():
            before -= 1
        if source[before] == "=" and m[0] not in gone:
            close = source.find(m[0], at)
            if close < 0:
                gone.add(m[0])
            else:
                at = close + 1
    return -1


def tokens(source: str | None) -> Iterator[tuple[str, str, str]]:
    """("text", its words as written, ""), ("start", name, attributes as written) and ("end", name, ""), in the page's order.

    The text of ``RAW`` elements comes as it stands between their tags.
    """
    source, at, gone = source or "", 0, set()
    while at < len(source):
        m = _OPEN.search(source, at)
        if m is None:
            yield "text", source[at:], ""
            return
        less = m.start()
        if less > at:
            yield "text", source[at:less], ""
        if source.startswith("<!--", less):
            end = source.find("-->", less + 4)
            if end < 0:
                return
            at = end + 3
            continue
        closes = source.startswith("/", less + 1)
        name = _NAME.match(source, less + 1 + closes)
        if name is None:
            end = source.find(">", less)
            if end < 0:
                return
            at = end + 1
            continue
        end = _tag_end(source, name.end(), gone)
        if end < 0:
            return
        at, tag = end + 1, name[0].lower()
        if closes:
            yield "end", tag, ""
            continue
        yield "start", tag, source[name.end() : end]
        if tag in RAW:
            stop = _RAW_END[tag].search(source, at)
            if stop is None:
                yield "text", source[at:], ""
                return
            if stop.start() > at:
                yield "text", source[at : stop.start()], ""
            at = stop.start()
