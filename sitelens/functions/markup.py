"""Tags of a page, found in time linear in its length whatever it holds."""

from __future__ import annotations

import re
from collections.abc import Iterator

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_NEXT = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it is an end tag, name and attributes of each tag; the name is empty for a comment
    or declaration, which runs to the page's end where nothing ends it.

    A quote opens a value only after an equals sign. A value that nothing closes ends with its tag, at the next `>`;
    what has no `>` after it is text."""
    at, last, quotes, broken = 0, page.rfind(">"), {q: page.rfind(q) for q in "\"'"}, False
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, False, "", ""
        elif page[at : at + 1] in ("!", "?"):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
            yield start, at, False, "", ""
        elif at <= last and (m := _NAME.match(page, at)):
            place, end = m.end(), -1
            while not broken and (found := _NEXT.search(page, place)):
                if found[0] == ">":
                    end = found.start()
                    break
                if quotes[found[0][-1]] < found.end():
                    end = page.find(">", found.end())
                    break
                place = page.find(found[0][-1], found.end()) + 1
            if end < 0:
                # Quotes pair to the end of the page without a `>` outside of them; from here on they count for nothing.
                broken, end = True, page.find(">", m.end())
            if end >= 0:
                at = end + 1
                yield start, at, bool(m[1]), m[2].lower(), page[m.end() : end]


def attributes(text: str) -> Iterator[tuple[str, str]]:
    """Names in lower case and values as written, without quotes."""
    for name, value in _ATTRIBUTE.findall(text):
        yield name.lower(), value[1:-1] if value[:1] in ("'", '"') else value


class RawEnds:
    """Where the content of raw elements ends. What ends nowhere is looked for once."""

    def __init__(self, page: str):
        self.page, self.endless = page, set()

    def after(self, tag: str, at: int) -> tuple[int, int] | None:
        """Start and end of the next end tag of a raw element; None where there is none."""
        found = None if tag in self.endless else re.compile(rf"</{tag}\b", re.I).search(self.page, at)
        if found is None:
            self.endless.add(tag)
            return None
        return found.start(), self.page.find(">", found.end()) + 1 or len(self.page)
